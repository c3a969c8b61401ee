"""Structured Streaming versions of the jobs.

* ``read_clean_stream`` – normalised transactions from Kafka (value JSON)
  or from a file folder (tests, replay).
* ``start_feature_queries`` – one streaming aggregation per entity x window
  with a 1 h watermark, update mode, a checkpoint per query (T1-T6).
* ``start_ingest`` – raw payload stream -> validate -> clean and dead-letter
  sinks from one micro-batch (T7).
* ``start_scoring`` – each micro-batch is enriched from the feature state and
  itself, ruled, decided and counted (T8).
* ``start_graph_upkeep`` – each micro-batch adds to the graph's merge log, a
  manifest per batch id makes replays idempotent (T9).

Every ``foreachBatch`` writer is idempotent per batch id (output folders are
named by batch id and written with overwrite), so a restarted query that
replays a batch replaces its output instead of adding it twice.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..operators import features as FE
from ..operators import ingest as IN
from ..operators.decision import decide
from ..operators.enrich import attach_limits, attach_trails
from ..operators.rules import evaluate_rules
from . import maintained as MT
from . import trail_state as TS
from .merge_log import BUCKETS, MergeLog
from .sinks import BatchSink, write_decisions, write_dlq
from .state import BatchState

NORMALIZED_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("timestamp_utc", T.StringType(), False),
    T.StructField("amount_rial", T.LongType(), False),
    T.StructField("card_pan", T.StringType(), True),
    T.StructField("account_number", T.StringType(), True),
    T.StructField("national_code", T.StringType(), True),
    T.StructField("mobile_e164", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("is_carrier_nat", T.BooleanType(), True),
    T.StructField("ip_confidence", T.DoubleType(), True),
    T.StructField("device_fp_hash", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("result", T.StringType(), True),
    T.StructField("is_night", T.BooleanType(), True),
])


def read_clean_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                      options: dict | None = None, schema: T.StructType | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: normalised transactions as a stream with ``event_time``.

    ``fmt="kafka"`` subscribes to the clean topic (latest offsets, no failure
    on data loss); any file format reads ``path`` with a fixed schema."""
    opts = dict(options or {})
    if fmt == "kafka":
        opts.setdefault("subscribe", config.TOPIC_CLEAN)
        opts.setdefault("startingOffsets", "latest")
        opts.setdefault("failOnDataLoss", "false")
        raw = spark.readStream.format("kafka").options(**opts).load()
        parsed = raw.select(F.from_json(F.col("value").cast("string"), NORMALIZED_SCHEMA).alias("d")).select("d.*")
        return parsed.withColumn("event_time", F.col("timestamp_utc").cast("timestamp"))
    reader = spark.readStream.format(fmt).options(**opts)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.schema(schema).load(path) if schema is not None else reader.load(path)
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", F.col("timestamp_utc").cast("timestamp"))
    return df


def feature_stream(stream: DataFrame, entity: str, win: str, distinct: str = "sketch",
                   watermark: str = config.WATERMARK_DELAY) -> DataFrame:
    """T1 + T2: watermarked tumbling-window aggregate of one entity.
    ``countDistinct`` is not allowed on streams: ``sketch`` (HLL, mergeable)
    or ``set`` (exact) count distinct values instead."""
    if distinct == "exact":
        distinct = "set"
    return FE.window_features(stream, entity, win, distinct=distinct, watermark=watermark)


def _sink(df: DataFrame, name: str, checkpoint: str, sink: str, path: str | None, trigger: dict,
          output_mode: str, options: dict | None):
    w = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
           .queryName(name).trigger(**trigger))
    if sink == "kafka":
        opts = dict(options or {})
        opts.setdefault("topic", config.TOPIC_FEATURES)
        return w.format("kafka").options(**opts).start()
    if sink == "memory":
        return w.format("memory").start()
    if sink == "parquet-batches":
        def write(batch: DataFrame, batch_id: int):
            batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id:012d}"))
        return w.foreachBatch(write).start()
    raise ValueError(sink)


def start_feature_queries(stream: DataFrame, checkpoint_base: str, sink: str = "kafka",
                          path: str | None = None, entities: list[str] | None = None,
                          windows: list[str] | None = None, distinct: str = "sketch",
                          trigger: dict | None = None, options: dict | None = None, as_json: bool = True):
    """One query per entity x window (16 by default), update mode,
    checkpoint ``<base>/<entity>_<window>``.  Returns the started queries;
    ``spark.streams.awaitAnyTermination()`` waits on all of them."""
    trigger = trigger or {"processingTime": config.TRIGGER_INTERVAL}
    started = []
    for win in windows or config.WINDOWS:
        for entity in entities or list(FE.ENTITIES):
            f = feature_stream(stream, entity, win, distinct)
            out = FE.feature_json(f) if as_json else f
            tag = f"{entity}_{win.replace(' ', '_')}"
            started.append(_sink(out, f"features_{tag}", os.path.join(checkpoint_base, tag), sink,
                                 os.path.join(path, tag) if path else None, trigger, "update", options))
    return started


def start_ingest(raw_stream: DataFrame, clean_path: str, dlq_path: str, checkpoint: str,
                 trigger: dict | None = None):
    """Validate once per micro-batch, write clean rows and dead letters.
    The manifests of the clean sink count both (A8); ``sinks.totals`` adds them up."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        v = IN.validate(IN.parse_payloads(batch)).persist()
        try:
            clean, dlq = IN.split(v)
            dead = write_dlq(BatchSink(spark, dlq_path), batch_id, dlq)
            BatchSink(spark, clean_path).write(batch_id, clean, {"ok": F.count(F.lit(1))}, dead)
        finally:
            v.unpersist()
    return (raw_stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": config.TRIGGER_INTERVAL}))
            .foreachBatch(write).start())


def score_batch(batch: DataFrame, batch_id: int, state: BatchState, sink: BatchSink, ml_scores: DataFrame | None = None,
                lateness: int = TS.LATENESS, accounts: MergeLog | None = None) -> None:
    """T8 for one micro-batch: trailing features over state and batch, rules,
    decisions; then the batch's own rows go into the state.  With ``accounts``
    the account tables take the decisions in, read back from the sink."""
    state.check(batch_id)
    batch = batch.persist()
    try:
        t = F.unix_micros("event_time")
        known = state.last(batch_id) or {"newest": None}
        floor = None if known["newest"] is None else known["newest"] - lateness * 1_000_000
        late = F.count_if(t < floor) if floor is not None else F.lit(0).cast("long")
        t0, t1, late = batch.agg(F.min(t), F.max(t), late).first()
        if t0 is None:
            t0 = t1 = known["newest"] or 0
        newest = max(t1, known["newest"] or t1)
        own = state.kept("batch-points", batch_id, TS.batch_points(batch))
        values = state.kept("batch-values", batch_id, TS.batch_values(batch))
        swept = state.kept("features", batch_id, TS.features(own, values, state, batch_id, t0, t1))
        featured = attach_trails(batch, {e: TS.of_entity(swept, e) for e in TS.TRAILS})
        write_decisions(sink, batch_id, decide(evaluate_rules(attach_limits(featured)), ml_scores), {"late": late})
        if accounts is not None:
            MT.account_batch(accounts, batch_id, sink.batch(batch_id))
        state.write(batch_id, TS.additions(own, values), {"newest": newest, "late": late})
        state.fold(batch_id, TS.merges(newest, lateness))
    finally:
        batch.unpersist()


def start_scoring(tx_stream: DataFrame, decisions_path: str, state_path: str, checkpoint: str,
                  ml_scores: DataFrame | None = None, trigger: dict | None = None, lateness: int = TS.LATENESS,
                  accounts_path: str | None = None, buckets: int = BUCKETS):
    """Every transaction is ruled, decided and counted with the trailing
    features of all transactions that came so far.  ``BatchSink.read`` gives
    the decisions, ``sinks.totals`` the counters.  With ``accounts_path`` the
    account tables (M5, M6) are kept there in so many buckets."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        accounts = MT.account_log(spark, accounts_path, buckets) if accounts_path else None
        score_batch(batch, batch_id, BatchState(spark, state_path, TS.SCHEMAS), BatchSink(spark, decisions_path), ml_scores, lateness, accounts)
    return (tx_stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": config.TRIGGER_INTERVAL}))
            .foreachBatch(write).start())


def start_graph_upkeep(tx_stream: DataFrame, graph_path: str, checkpoint: str,
                       person_key: str = "transaction", trigger: dict | None = None, buckets: int = BUCKETS):
    """Each micro-batch adds its nodes and edges to the graph's merge log
    and rewrites only buckets that are due.  ``maintained.read_graph`` gives
    the graph; a replayed batch changes nothing."""
    def write(batch: DataFrame, batch_id: int):
        MT.upkeep_batch(MT.graph_log(batch.sparkSession, graph_path, buckets), batch_id, batch, person_key)
    return (tx_stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": config.TRIGGER_INTERVAL}))
            .foreachBatch(write).start())
