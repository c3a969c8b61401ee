"""Equi-joins that stay balanced when one key holds a large share of the rows.

A table of one row a key, made by an aggregate, meets the rows it was made from
in a shuffle join: all rows of a hot key go to one task, and adaptive execution
cannot split it below an aggregate.  ``hot_keys`` finds such keys with a
mergeable frequent-items sketch, one per map task, in one scan for any number of
joins; ``salted_join`` deals only their rows over salts and gives each salt a
copy of their one row.  Keys that the sketch misses are joined as any other, so
the result never depends on it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most frequent keys that the sketch returns, and keys it tracks.
TOP, TRACKED = 64, 4096


def key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*on)


def is_broadcast(df: DataFrame) -> bool:
    """Whether all of ``df``, and so any aggregate of it, is below the size that
    Spark broadcasts: then no join with one shuffles."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 <= size <= limit


def hot_keys(df: DataFrame, joins: dict[str, list[str]]) -> dict[str, dict[int, int]]:
    """Join name -> {hash of a hot key: salts}: keys with more rows than half a
    task of an even shuffle; at most ``TOP`` a join reach the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.select(*[key_hash(on).alias(name) for name, on in joins.items()])
    found = hashed.agg(F.count(F.lit(1)).alias("_rows"), *[F.expr(f"approx_top_k(`{name}`, {TOP}, {TRACKED})").alias(name)
                                                           for name in joins]).first()
    even = max(1.0, found["_rows"] / parts)
    return {name: {r["item"]: min(4 * parts, int(8 * r["count"] / even)) for r in found[name] or [] if r["count"] > even / 2 and r["count"] > 1}
            for name in joins}


def salted_join(rows: DataFrame, each: DataFrame, on: list[str], hot: dict[int, int], how: str = "left") -> DataFrame:
    """``rows`` joined (left or inner) with ``each``, which has few rows a key."""
    if not hot:
        return rows.join(each, on, how)
    salts = F.create_map(*[x for h, n in hot.items() for x in (F.lit(h).cast("bigint"), F.lit(n))])
    many = F.coalesce(salts[key_hash(on)], F.lit(1))
    # a salt that depends on the row alone: a task that runs again deals alike
    own = [c.name for c in rows.schema.fields if c.dataType.typeName() not in ("map", "variant")]
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), *own), many).cast("int"))
    right = each.withColumn("_salt", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
