"""Registered queries: streaming twins of batch queries.

The transactions derived from the driver tables are written once to a
folder under the shared checkpoint directory and replayed as a file stream
with ``availableNow``; the results must equal the batch twin.  Replays in time
order hand over a range of times a micro-batch."""
from __future__ import annotations

import math
import os
import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..operators import features as FE
from ..session import scratch_path
from ..sources import testdata as TD
from ..streaming import maintained as MT
from ..streaming import pipelines as S
from ..streaming import rollups as RS
from ..streaming.polling import poll
from ..streaming.sinks import BatchSink, totals
from ..streaming.state import Files
from . import oracle as O
from .q_core import SQL_FEATURES_ALL, SQL_TRAILING_DECISIONS, _decisions_sql, _sql_ingest, _trailing_ctes, decision_columns, rounded_features, sql_features
from .q_graph import SQL_GRAPH_MERGE, SQL_GRAPH_NODES_BY_CODE
from .q_monitor import ACCOUNT_RISK_STATUS, BLOCKED_ACCOUNTS, _blocked, _fix


STREAM_COLUMNS = [f.name for f in S.NORMALIZED_SCHEMA.fields] + ["event_time", "account_type",
                                                                  "mobile_normalized", "device_fingerprint"]


MICRO_BATCHES = 8
ROLLUP_BATCHES = 4
FILE_ROWS = 32_768
BUCKETS = 8  # of the merge logs; a deployment sets as many as make a bucket fit a task


def _in_order(spark, folder):
    """Give files modification times in the order of their names, which the
    file source follows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), 1_000_000_000_000 + 10_000 * i, -1)
    return len(names)


def _ordered_replay(spark, rows, order, run, batches=MICRO_BATCHES):
    """Stream of ``rows``, written under ``run`` in as many ranges of
    ``order`` as batches unless a run before did.  A range is cut into files of
    about ``FILE_ROWS`` rows, as one file is read by one task; a micro-batch
    takes the files of one range."""
    source = os.path.join(run, "source")
    if not Files(spark).exists(os.path.join(source, "_SUCCESS")):
        files = max(1, math.ceil(rows.count() / (batches * FILE_ROWS)))
        rows.repartitionByRange(batches * files, order).write.mode("overwrite").parquet(source)
        _in_order(spark, source)
    written = sum(n.startswith("part-") for n in Files(spark).names(source))
    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, math.ceil(written / batches))).parquet(source)


def _replay_source(spark, sf):
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    tx = TD.transactions(spark, sf).select(*STREAM_COLUMNS)
    tx.write.mode("overwrite").parquet(os.path.join(run, "source"))
    schema = spark.read.parquet(os.path.join(run, "source")).schema
    stream = S.read_clean_stream(spark, fmt="parquet", path=os.path.join(run, "source"), schema=schema)
    return run, stream


def q_stream_features_card(spark, sf):
    run, stream = _replay_source(spark, sf)
    out = os.path.join(run, "features")
    qs = S.start_feature_queries(stream, os.path.join(run, "ckpt"), sink="parquet-batches", path=out,
                                 entities=["card"], distinct="set", trigger={"availableNow": True},
                                 as_json=False)
    for q in qs:
        q.awaitTermination()
    res = None
    for w in config.WINDOWS:
        part = spark.read.parquet(os.path.join(out, f"card_{w.replace(' ', '_')}"))
        res = part if res is None else res.unionByName(part)
    # update mode may emit a group in several batches: keep its final state
    res = res.withColumn("_b", F.col("batch"))
    last = Window.partitionBy("entity_id", "window_duration", "window").orderBy(F.col("_b").desc())
    res = res.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_b", "batch")
    flat = res.select("entity_type", "entity_id", "window_duration",
                      F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *[c for c in res.columns if c.startswith("card_") and c != "card_pan"])
    return rounded_features(flat)


def _scored_stream(spark, sf):
    """The decisions sink after all transactions came in time order.  Source,
    state, sink and checkpoint stay in one folder: a second run goes on where
    the first ended."""
    run = scratch_path(spark, f"scored-stream-{TD._fingerprint(spark, sf)}")
    stream = _ordered_replay(spark, TD.transactions(spark, sf).select(*STREAM_COLUMNS), "event_time", run)
    sink = os.path.join(run, "decisions")
    S.start_scoring(stream, sink, os.path.join(run, "state"), os.path.join(run, "ckpt"), trigger={"availableNow": True},
                    accounts_path=os.path.join(run, "accounts"), buckets=BUCKETS).awaitTermination()
    return BatchSink(spark, sink)


def q_stream_decisions(spark, sf):
    """Decisions of a stream in micro-batches, with the trailing features of
    all transactions up to each one."""
    return decision_columns(_scored_stream(spark, sf).read())


def q_stream_decision_totals(spark, sf):
    """What the scoring stream counted, added up over its batches."""
    return totals(_scored_stream(spark, sf), ["total_tx", "blocked", *config.RISK_LEVELS, "late"])


def _account_tables(spark, sf):
    return MT.account_log(spark, os.path.join(os.path.dirname(_scored_stream(spark, sf).folder), "accounts"), BUCKETS)


def q_stream_account_status(spark, sf):
    """M5 as the scoring stream keeps it, batch by batch."""
    return MT.account_risk_status(_account_tables(spark, sf))


def q_stream_blocked_accounts(spark, sf):
    """M6 as the scoring stream keeps it, batch by batch."""
    return _blocked(MT.blocked_accounts(_account_tables(spark, sf)))


def _kept_graph(spark, sf):
    """The graph, one Person a national code, after all transactions came in
    time order."""
    run = scratch_path(spark, f"graph-stream-{TD._fingerprint(spark, sf)}")
    stream = _ordered_replay(spark, TD.transactions(spark, sf).select(*STREAM_COLUMNS), "event_time", run)
    graph = os.path.join(run, "graph")
    S.start_graph_upkeep(stream, graph, os.path.join(run, "ckpt"), "national_code", {"availableNow": True}, BUCKETS).awaitTermination()
    return MT.read_graph(MT.graph_log(spark, graph, BUCKETS))


def q_stream_graph(spark, sf):
    """The edges that micro-batches left in the graph's merge log."""
    return _kept_graph(spark, sf)[1].drop("last_event_time")


def q_stream_graph_nodes(spark, sf):
    """The nodes beside them."""
    return _kept_graph(spark, sf)[0]


SQL_STREAM_DECISION_TOTALS = _decisions_sql(f"""
SELECT count(*) AS total_tx, count(*) FILTER (WHERE should_block) AS blocked,
  {", ".join(f"count(*) FILTER (WHERE risk_level = '{x}') AS {x}" for x in config.RISK_LEVELS)},
  0::BIGINT AS late, {MICRO_BATCHES}::BIGINT AS batches FROM decided""", _trailing_ctes())


def _ingested_stream(spark, sf):
    """(clean sink, dead-letter sink) after all raw payloads came in."""
    run = scratch_path(spark, f"ingested-stream-{TD._fingerprint(spark, sf)}")
    stream = _ordered_replay(spark, TD.raw_payloads(spark, sf), "payload", run)
    clean, dead = os.path.join(run, "clean"), os.path.join(run, "dlq")
    S.start_ingest(stream, clean, dead, os.path.join(run, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    return BatchSink(spark, clean), BatchSink(spark, dead)


def q_stream_ingest_totals(spark, sf):
    """A8 over micro-batches: clean and rejected rows, and batches."""
    return totals(_ingested_stream(spark, sf)[0], ["ok", "dlq"])


def q_stream_dlq(spark, sf):
    """Dead letters of the stream, read back from their sink."""
    return _ingested_stream(spark, sf)[1].read().select("transaction_id", "raw_payload", "error", "source")


PAGE_ROWS = 4096


def q_ingest_pages(spark, sf):
    """The clean table polled in pages after a cursor, with each row's page."""
    sink = BatchSink(spark, scratch_path(spark, f"pages-{TD._fingerprint(spark, sf)}"))
    poll(TD.transactions(spark, sf), sink, PAGE_ROWS)
    return sink.read().select("page", "transaction_id", "timestamp_utc", "amount_rial")


SQL_INGEST_PAGES = O.with_tx(f"""
SELECT (row_number() OVER (ORDER BY timestamp_utc, transaction_id) - 1) // {PAGE_ROWS} AS page,
  transaction_id, timestamp_utc, amount_rial FROM tx""")

SQL_STREAM_INGEST_TOTALS = _sql_ingest(f"""
SELECT count(*) FILTER (WHERE error IS NULL) AS ok, count(*) FILTER (WHERE error IS NOT NULL) AS dlq,
  {MICRO_BATCHES}::BIGINT AS batches FROM judged""")

SQL_STREAM_DLQ = _sql_ingest("""
SELECT transaction_id, error, 'bank_api' AS source,
  '{"transaction_id":"' || transaction_id || '","timestamp":"' || ts_text || '","amount_rial":' || amount_raw
  || ',"card_pan":"' || card_raw || '","account_number":"' || account_number || '","national_code":"' || nc_raw
  || '","mobile":"' || mobile_raw || '","ip_address":"' || ip_raw || '","device_fingerprint":"' || dev_raw
  || '","channel":"' || channel || '","result":"' || result || '"}' AS raw_payload
FROM judged WHERE error IS NOT NULL""")

def q_stream_features_all(spark, sf):
    """The 16 feature tables (entity x window) from one stream an
    entity, as they stand after the last batch."""
    run = scratch_path(spark, f"rolled-stream-{TD._fingerprint(spark, sf)}")
    stream = _ordered_replay(spark, TD.transactions(spark, sf).select(*STREAM_COLUMNS), "event_time", run, ROLLUP_BATCHES)
    out = os.path.join(run, "features")
    RS.watch(spark, RS.start_rollups(stream, out, os.path.join(run, "ckpt"), trigger={"availableNow": True}))
    parts = [RS.current(spark, out, e) for e in FE.ENTITIES]
    return rounded_features(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


QUERIES = {
    "ingest_pages": (q_ingest_pages, SQL_INGEST_PAGES),
    "stream_features_card": (q_stream_features_card, sql_features("card")),
    "stream_decisions": (q_stream_decisions, SQL_TRAILING_DECISIONS),
    "stream_account_status": (q_stream_account_status, _decisions_sql(ACCOUNT_RISK_STATUS, _trailing_ctes())),
    "stream_blocked_accounts": (q_stream_blocked_accounts, _fix(_decisions_sql(BLOCKED_ACCOUNTS, _trailing_ctes()))),
    "stream_graph": (q_stream_graph, SQL_GRAPH_MERGE),
    "stream_graph_nodes": (q_stream_graph_nodes, SQL_GRAPH_NODES_BY_CODE),
    "stream_decision_totals": (q_stream_decision_totals, SQL_STREAM_DECISION_TOTALS),
    "stream_features_all": (q_stream_features_all, SQL_FEATURES_ALL),
    "stream_ingest_totals": (q_stream_ingest_totals, SQL_STREAM_INGEST_TOTALS),
    "stream_dlq": (q_stream_dlq, SQL_STREAM_DLQ),
}
