"""Per-key ordered operators that stay parallel on hot keys.

A window partitioned by a key puts all rows of that key into one task.  For
a key holding a third of the data that is one straggler task, so the
ordered operators here split every key into time chunks:

* ``key_rank`` numbers the rows of each key in (time, id) order: chunk
  sizes come from a partial aggregate, chunk offsets from a window over the
  (small) chunk table, and the rank inside a chunk from a window over
  (key, chunk).
* ``last_n`` builds, for every row, the list of the ``n`` latest rows of its
  key up to itself.  Rows are grouped in rank buckets of ``10n``; each bucket
  also receives the last ``n - 1`` rows of the previous one as a halo, so a
  window over (key, bucket) sees fewer than ``11n`` rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config


def key_rank(df: DataFrame, key: str, ts: str = "event_time", tie: str = "transaction_id",
             chunk_seconds: int = config.CHUNK_SECONDS, out: str = "seq_rank") -> DataFrame:
    """1-based position of each row within its key, ordered by (ts, tie)."""
    chunk = F.floor(F.unix_micros(F.col(ts)) / F.lit(chunk_seconds * 1_000_000)).cast("long")
    # NULL keys form one group of their own: they get a surrogate join key.
    d = df.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))).withColumn("_chunk", chunk)
    sizes = d.groupBy("_k", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_k", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_k", "_chunk").orderBy(F.col(ts), F.col(tie)))
    ranked = d.withColumn("_local", local).join(offsets, on=["_k", "_chunk"], how="inner")
    return (ranked.withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
                  .drop("_k", "_chunk", "_local", "_off"))


#: Lists of ``n`` rows that a bucket of ``last_n`` holds, besides its halo.
BUCKET_LISTS = 10


def last_n(df: DataFrame, key: str, item: Column, n: int, rank: str = "seq_rank",
           extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``_items``: array of ``item`` for the ``n`` latest rows of the key
    up to and including the row (oldest first).  ``extra`` window
    expressions (``lag`` by up to ``n - 1``, at least one) are evaluated over the
    same bounded frames."""
    size, halo_rows = BUCKET_LISTS * n, max(n - 1, 1)
    place = F.col(rank) - 1
    base = df.withColumn("_item", item).withColumn("_tb", F.floor(place / F.lit(size)).cast("long"))
    own = base.withColumn("_halo", F.lit(False))
    halo = base.where(place % size >= size - halo_rows).withColumn("_tb", F.col("_tb") + 1).withColumn("_halo", F.lit(True))
    u = own.unionByName(halo)
    part = Window.partitionBy(key, "_tb").orderBy(rank)
    u = u.withColumn("_items", F.collect_list("_item").over(part.rowsBetween(-(n - 1), 0)))
    for name, expr in (extra or {}).items():
        u = u.withColumn(name, expr.over(part))
    return u.filter(~F.col("_halo")).drop("_item", "_tb", "_halo")
