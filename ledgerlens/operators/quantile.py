"""Exact percentiles of a column at any size, by distributed rank selection.

A histogram of equal bins over the range that holds the wanted rank is counted
with partial aggregation; the range shrinks to the bin of the rank until few
enough rows lie in it, and only those, as distinct values with counts, come to
the driver.  The next value above is one more minimum.  Memory is bounded by
the bins and ``FEW``, whatever the number of rows or ties.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 4096, 4096


def value_at(df: DataFrame, rank: int, low: float, high: float) -> tuple[float, int]:
    """(the value of a rank from 0 among column ``v``, the rows up to it)."""
    before = 0  # rows below ``low``
    v = F.col("v")
    while low < high:
        width = high / BINS - low / BINS
        if width <= 0 or low + width <= low:  # neighbouring numbers: their values are few
            break
        at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((v - low) / width))).cast("int")
        inside = df.where((v >= low) & (v <= high)).select(v, at.alias("bin"))
        found = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # BINS rows
        total = before
        for r in sorted(found):
            if total + r.n > rank:
                break
            total += r.n
        before, low, high = total, r.low, r.high
        if r.n <= FEW:
            break
    few = df.where((v >= low) & (v <= high)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(FEW).collect()
    for r in few:
        before += r.n
        if before > rank:
            return r.v, before
    raise AssertionError("rank beyond the rows")


def exact_percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The percentile at ``share`` in [0, 1] of the finite values, linearly
    interpolated between the two nearest ranks; None without a value."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = (n - 1) * share
    rank = math.floor(place)
    below, upto = value_at(values, rank, low, high)
    if place == rank:
        return below
    above = below if upto > rank + 1 else values.where(F.col("v") > below).agg(F.min("v")).first()[0]
    return below + (above - below) * (place - rank)
