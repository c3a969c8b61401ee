"""T1-T6 with one stream an entity: all windows from hourly partials.

Each micro-batch adds its hourly partials and values to the entity's state and
emits, in update mode, the features of the windows that it touched.  Windows
that ended before the watermark (the newest time of the batches before, less
the delay) are final: rows that come for them later are counted as late and
change them no more.  State older than the longest window and the delay expires.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..operators import features as FE
from ..operators import rollup as R
from .sinks import BatchSink
from .state import BatchState

SCHEMAS = {"partials": R.PARTIAL, "values": R.VALUES}
MICROS = 1_000_000
DELAY = 3600


def merges(newest: int, delay: int):
    """The merge of each table; what no open window holds expires."""
    cut = newest - (max(config.WINDOW_SECONDS.values()) + delay) * MICROS
    fresh = F.col("hour") >= F.timestamp_micros(F.lit(cut))
    return {"partials": lambda df: R.merged(df.where(fresh), ["entity_id", "hour"]), "values": lambda df: df.where(fresh).distinct()}


def roll_batch(batch: DataFrame, batch_id: int, entity: str, state: BatchState, emit, windows: list[str] | None = None,
               delay: int = DELAY) -> None:
    """One micro-batch of one entity; ``emit(rows, late)`` gets the windows that
    it touched and how many (row, window) pairs came too late."""
    windows = windows or config.WINDOWS
    state.check(batch_id)
    known = (state.last(batch_id) or {}).get("newest")
    timed = batch.where("event_time is not null")
    new = state.put(batch_id, {"partials": R.hourly(timed, entity, [F.max("event_time").alias("newest")]), "values": R.hourly_values(timed, entity)})
    partials = new["partials"]
    touched = R.in_windows(partials.withColumn("at", F.col("hour")), windows)
    length = F.create_map(*[F.lit(x) for w in windows for x in (w, config.WINDOW_SECONDS[w] * MICROS)])
    ends = F.unix_micros("window_start") + length[F.col("window_duration")]
    is_open = F.lit(True) if known is None else ends > known - delay * MICROS
    late, first, top = touched.agg(F.coalesce(F.sum(F.when(~is_open, F.col("n"))), F.lit(0)), F.unix_micros(F.min("at")),
                                   F.unix_micros(F.max("newest"))).first()
    newest = max((x for x in (top, known) if x is not None), default=None)
    only = touched.where(is_open).select("entity_id", "window_duration", "window_start").distinct()
    # no touched window starts before the one of the first hour
    start = min((first or 0) - (first or 0) % (config.WINDOW_SECONDS[w] * MICROS) for w in windows)
    since = F.col("hour") >= F.timestamp_micros(F.lit(start))
    before = state.read("partials", batch_id).where(since).unionByName(partials.drop("newest"))
    seen = state.read("values", batch_id).where(since).unionByName(new["values"])
    emit(R.rolled_up(before, seen, entity, windows, only), late)
    state.commit(batch_id, {"newest": newest, "late": late})
    if newest is not None:
        state.fold(batch_id, merges(newest, delay))


def start_rollups(stream: DataFrame, path: str, checkpoint_base: str, entities: list[str] | None = None,
                  windows: list[str] | None = None, sink: str = "parquet", options: dict | None = None,
                  trigger: dict | None = None, delay: int = DELAY) -> dict[str, StreamingQuery]:
    """One query an entity for all windows.  ``sink="kafka"`` sends feature JSON
    to the topic; else each entity's rows go to ``<path>/<entity>``, one folder a
    window in each batch."""
    started = {}
    for entity in entities or list(FE.ENTITIES):
        def write(batch: DataFrame, batch_id: int, entity=entity):
            spark = batch.sparkSession
            out = BatchSink(spark, os.path.join(path, entity))

            def emit(rows, late):
                if sink == "kafka":
                    FE.feature_json(rows).write.format("kafka").options(**({"topic": config.TOPIC_FEATURES} | (options or {}))).save()
                else:
                    out.write(batch_id, rows, {"windows": F.count(F.lit(1))}, {"late": late}, by="window_duration")
            roll_batch(batch, batch_id, entity, BatchState(spark, os.path.join(path, f"{entity}-state"), SCHEMAS), emit, windows, delay)
        started[entity] = (stream.select(*R.needed(entity)).writeStream.queryName(f"rollup_{entity}").option("checkpointLocation", os.path.join(checkpoint_base, entity))
                           .trigger(**(trigger or {"processingTime": config.TRIGGER_INTERVAL})).foreachBatch(write).start())
    return started


def watch(spark: SparkSession, queries: dict[str, StreamingQuery]) -> None:
    """Wait until all queries end; when one fails, stop the others and raise.
    Other queries of the session, and how they ended, are not looked at."""
    left = list(queries.values())
    try:
        while left:
            left = [q for q in left if not q.awaitTermination(1)]  # raises what a query ended with
    finally:
        for q in queries.values():
            if q.isActive:
                q.stop()


def current(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The latest features of every key and window of an entity."""
    rows = BatchSink(spark, os.path.join(path, entity)).read()
    keys = ["entity_type", "entity_id", "window_duration", "window_start"]
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "batch"])
