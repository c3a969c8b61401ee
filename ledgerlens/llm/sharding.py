"""Sharding by a permutation-filled lookup table.

A table has a prime number of slots.  Every shard has an offset and a step,
both from hashes of its name, and so an order of preference over all slots.
The shards take turns; each claims the first slot of its order that is still
free, until none is.  A row's slot is the hash of its key modulo the number of
slots; one broadcast look-up gives its shard.  When a shard leaves or joins,
few rows move besides those it had or gets.

The driver fills the table, whose size is a parameter and never follows the
data; rows are placed by DataFrame expressions and a broadcast join with it.

Cases: a null key hashes as the empty string; equal keys get equal shards; key
columns named like results are replaced; an empty table gives no rows; the
shard names must be distinct and not null, the number of slots a prime larger
than their number.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults; about a hundred slots a shard keep the shards' slots within 1 %.
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(20)], 2003


def hashed(value, salt: str) -> F.Column:
    """60 bits of the MD5 of salt and value, as a number that is not negative."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value).cast("binary")), 1, 15), 16, 10).cast("bigint")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def hashed_name(name: str, salt: str) -> int:
    return int(hashlib.md5((salt + name).encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that has claimed each slot."""
    n = len(shards)
    if not n or len(set(shards)) != n or not is_prime(slots) or slots <= n:
        raise ValueError("needs distinct shard names and a prime number of slots above their number")
    at = [hashed_name(s, "offset:") % slots for s in shards]
    step = [hashed_name(s, "step:") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % n
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of every slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",").cast("array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        "slot", F.element_at(names, F.col("owner") + 1).alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    value = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slotted = df.select(*rest, (hashed(value, "key:") % slots).cast("int").alias("slot"))
    return slotted.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot").select(*rest, "slot", "shard")


def place_sql(table: str, key: str, columns: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> str:
    """The same placement, table filling included, as DuckDB SQL."""
    n = len(shards)
    names = ", ".join(f"('{s}', {i})" for i, s in enumerate(shards))
    h = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
    WITH RECURSIVE shards(name, i) AS (VALUES {names}),
    prefs AS (SELECT i, list_transform(range(0, {slots}),
        lambda j: ({h.format("'offset:' || name")} % {slots} + j * ({h.format("'step:' || name")} % {slots - 1} + 1)) % {slots}) AS pref
      FROM shards),
    turns(t, own) AS (
      SELECT 0, list_transform(range(0, {slots}), lambda x: -1)
      UNION ALL
      SELECT t + 1, list_transform(own, lambda x, k: CASE WHEN k - 1 = slot THEN t % {n} ELSE x END)
      FROM (SELECT t, own, list_filter(pref, lambda x: own[x + 1] = -1)[1] AS slot FROM turns JOIN prefs ON i = t % {n} WHERE t < {slots})),
    slots AS (SELECT unnest(range(0, {slots}))::INTEGER AS slot, unnest(own) AS i FROM turns WHERE t = {slots}),
    placed AS (SELECT {columns}, ({h.format(f"'key:' || coalesce({key}::VARCHAR, '')")} % {slots})::INTEGER AS slot FROM {table})
    SELECT placed.*, name AS shard FROM placed JOIN slots USING (slot) JOIN shards USING (i)"""
