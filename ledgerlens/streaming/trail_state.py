"""Feature history for streaming scoring: trailing windows over state and batch.

State tables, one row group a batch, merged and expired by ``BatchState``:

* ``points`` (entity, key, time, sums) and ``values`` (entity, key, value,
  time): what a batch adds to the timelines, exact to the microsecond;
* ``point_hours`` (entity, key, hour, sums) and ``value_hours`` (entity, key,
  value, hour, last time): their mergeable hourly partials.

A batch with transactions from t0 to t1 needs, for a window of w seconds, the
rows since t0 - w.  Hours that lie in the windows of all its transactions, in
[t1 - w, t0], come as one partial a key; only the hours at the two edges are
read row by row.  Of the values before t0 the last time in each hour is
enough.  State rows of keys that the batch lacks are left out by a semi join.
The features are those of the batch job over all rows seen so far, whatever the
order in which the rows came, as long as they are no later than ``lateness``:
rows older than that are scored with what the state still holds and counted.
"""
from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import TRAILS, trail_measures, trail_values
from ..operators.features import ENTITIES
from ..operators.timeline import MICROS, sweep, timeline_key
from .state import BatchState

HOUR = 3600 * MICROS
SUMS = "n bigint, amount decimal(38,0), small bigint, failed bigint"
SCHEMAS = {
    "points": f"entity string, _k string, _t bigint, {SUMS}",
    "point_hours": f"entity string, _k string, hour bigint, {SUMS}",
    "values": "entity string, _k string, _v string, _t bigint",
    "value_hours": "entity string, _k string, _v string, hour bigint, _t bigint",
}
MEASURES = ["n", "amount", "small", "failed"]
LATENESS = 24 * 3600


def hour_of(t: Column) -> Column:
    return t - F.pmod(t, F.lit(HOUR))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: The trails of all entities on one timeline; distinct values in one column.
TOGETHER = [replace(tr, distincts={n: "_v" for n in tr.distincts}, entity=e) for e, trails in TRAILS.items() for tr in trails]
HORIZON = max(tr.seconds for tr in TOGETHER) * MICROS


def either(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def batch_points(tx: DataFrame) -> DataFrame:
    """Points of all entities."""
    kinds = {"amount": "decimal(38,0)"}

    def one(entity):
        own = trail_measures(entity)
        return F.struct(F.lit(entity).alias("entity"), timeline_key(ENTITIES[entity].key).alias("_k"), F.unix_micros("event_time").alias("_t"),
                        *[own.get(m, F.lit(0)).cast(kinds.get(m, "bigint")).alias(m) for m in MEASURES])
    rows = tx.where("event_time is not null").select(F.inline(F.array(*[one(e) for e in TRAILS])))
    return rows.groupBy("entity", "_k", "_t").agg(*sums())


def batch_values(tx: DataFrame) -> DataFrame:
    """Occurrences of all entities' values."""
    each = [F.struct(F.lit(e).alias("entity"), timeline_key(ENTITIES[e].key).alias("_k"), F.col(v).cast("string").alias("_v"),
                     F.unix_micros("event_time").alias("_t")) for e in TRAILS for v in trail_values(e)]
    return tx.where("event_time is not null").select(F.inline(F.array(*each))).where("_v is not null").distinct()


def sums() -> list[Column]:
    return [F.sum(m).cast("decimal(38,0)" if m == "amount" else "bigint").alias(m) for m in MEASURES]


def features(own: DataFrame, values: DataFrame, state: BatchState, batch: int, t0: int, t1: int) -> DataFrame:
    """(entity, _k, _t, features) at the keys and times of a batch's points
    ``own``; its times lie in [t0, t1].  Points and ``values`` are read several
    times: hand over written tables."""
    hour, t = F.col("hour"), F.col("_t")
    keys = own.select("entity", "_k").distinct()
    inside = [(hour >= t1 - tr.seconds * MICROS) & (hour + HOUR <= t0) for tr in TOGETHER]
    edge = [(hour + HOUR > t0 - tr.seconds * MICROS) & (hour <= t1) & ~i for tr, i in zip(TOGETHER, inside)]
    mine = [(F.col("entity") == tr.entity) if tr.sums else F.lit(False) for tr in TOGETHER]

    def of_keys(df):
        return df.join(keys, ["entity", "_k"], "left_semi")

    rows = state.read("points", batch).where((t >= t0 - HORIZON) & (t <= t1)).withColumn("hour", hour_of(t))
    rows = of_keys(rows.where(either([m & e for m, e in zip(mine, edge)])))
    whole = state.read("point_hours", batch).where((hour >= t0 - HORIZON) & (hour <= t0)).withColumn("_t", hour)
    whole = of_keys(whole.where(either([m & i for m, i in zip(mine, inside)])))
    columns = ["entity", "_k", "_t", "hour", *MEASURES]
    pts = union([own.withColumn("hour", hour_of(t)).select(*columns, F.lit(0).alias("_kind")),
                 rows.select(*columns, F.lit(1).alias("_kind")), whole.select(*columns, F.lit(2).alias("_kind"))])
    kind = F.col("_kind")
    old = state.read("value_hours", batch).where((hour + HOUR <= t0) & (t >= t0 - HORIZON))
    near = state.read("values", batch).where((t > t0 - HOUR) & (t <= t1)).where(hour_of(t) + HOUR > t0)
    seen = of_keys(union([old.select("entity", "_k", "_v", "_t"), near.select("entity", "_k", "_v", "_t")]))
    return sweep(pts, {"_v": union([seen, values])}, TOGETHER,
                 [(kind == 0) | ((kind == 1) & e) | ((kind == 2) & i) for e, i in zip(edge, inside)],
                 [kind == 2] * len(TOGETHER), kind == 0, ["entity", "_k"], lambda events: state.kept("events", batch, events))


def of_entity(swept: DataFrame, entity: str) -> DataFrame:
    """The features of one entity's trails by key and time."""
    return swept.where(F.col("entity") == entity).select("_k", "_t", *[n for tr in TRAILS[entity] for n in tr.names()])


def additions(own: DataFrame, vals: DataFrame) -> dict[str, DataFrame]:
    """What a batch of these points and values adds to every table."""
    summed = [e for e, trails in TRAILS.items() if any(tr.sums for tr in trails)]
    pts = own.where(F.col("entity").isin(summed))
    return {"points": pts.select("entity", "_k", "_t", *MEASURES), "values": vals, "point_hours": hours(pts), "value_hours": value_hours(vals)}


def hours(pts: DataFrame) -> DataFrame:
    return (pts.withColumn("hour", hour_of(F.col("_t"))).groupBy("entity", "_k", "hour")
               .agg(*sums()))


def value_hours(vals: DataFrame) -> DataFrame:
    return vals.withColumn("hour", hour_of(F.col("_t"))).groupBy("entity", "_k", "_v", "hour").agg(F.max("_t").alias("_t"))


def merges(newest: int, lateness: int = LATENESS) -> dict:
    """How the rows of every table merge into a base; what no window of a row
    that is at most ``lateness`` seconds late can reach expires."""
    cut = newest - HORIZON - lateness * MICROS - HOUR
    return {"points": lambda df: df.where(F.col("_t") >= cut).groupBy("entity", "_k", "_t").agg(*sums()),
            "point_hours": lambda df: df.where(F.col("hour") >= cut).groupBy("entity", "_k", "hour").agg(*sums()),
            "values": lambda df: df.where(F.col("_t") >= cut).distinct(),
            "value_hours": lambda df: df.where(F.col("hour") >= cut).groupBy("entity", "_k", "_v", "hour").agg(F.max("_t").alias("_t"))}
