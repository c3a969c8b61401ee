"""Tables that micro-batches keep up to date: the identity graph
and the account tables of the monitor (M5, M6)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import monitor as M
from .merge_log import BUCKETS, MergeLog, Table, newest, oldest

GRAPH = {
    "nodes": Table("label string, id string", ("label", "id")),
    "edges": Table(
        "rel_type string, from_label string, from_id string, to_label string, to_id string, timestamp_start string, "
        "timestamp_end string, confidence double, total_amount bigint, tx_count bigint, last_timestamp string, "
        "last_event_time timestamp",
        tuple(G.EDGE_KEY),
        lambda: {"timestamp_start": oldest("timestamp_start"), "timestamp_end": F.lit(G.OPEN_END_TEXT),
                 "confidence": newest("confidence"), "total_amount": F.sum("total_amount").cast("long"),
                 "tx_count": F.sum("tx_count").cast("long"), "last_timestamp": newest("last_timestamp"),
                 "last_event_time": newest("last_event_time")}),
}

ACCOUNTS = {
    "status": Table(
        "account_id string, latest struct<event_time: timestamp, transaction_id: string, risk_level: string, "
        "risk_score: double>, max_score double, tx_count bigint, blocked_count bigint, high_risk_count bigint",
        ("account_id",),
        lambda: {"latest": F.max("latest"), "max_score": F.max("max_score"),
                 **{c: F.sum(c).alias(c) for c in ("tx_count", "blocked_count", "high_risk_count")}}),
    "flagged": Table(
        "account_id string, flagged_count bigint, first_flagged timestamp, last_flagged timestamp", ("account_id",),
        lambda: {"flagged_count": F.sum("flagged_count"), "first_flagged": F.min("first_flagged"),
                 "last_flagged": F.max("last_flagged")}),
    "reasons": Table("account_id string, code string", ("account_id", "code")),
}


def graph_log(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> MergeLog:
    return MergeLog(spark, folder, GRAPH, buckets)


def upkeep_batch(log: MergeLog, batch: int, tx: DataFrame, person_key: str = "transaction") -> None:
    """T9 for one micro-batch: its nodes (J3) and its edges, summed up by key
    (J2), go to the log.  Both come from the same rows, so both end nodes of an
    edge are in the log with it (J1)."""
    tx = tx.persist()
    try:
        log.append(batch, {"nodes": G.graph_nodes(tx, person_key), "edges": G.graph_edges(tx, person_key)})
    finally:
        tx.unpersist()


def read_graph(log: MergeLog, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as of a batch."""
    return log.read("nodes", batch), log.read("edges", batch).select(*G.EDGE_COLUMNS)


def account_log(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> MergeLog:
    return MergeLog(spark, folder, ACCOUNTS, buckets)


def account_batch(log: MergeLog, batch: int, decisions: DataFrame) -> None:
    """M5, M6 for one micro-batch of decisions."""
    latest = F.struct("event_time", "transaction_id", "risk_level", "risk_score")
    risky = F.col("risk_level").isin("high", "critical")
    status = decisions.groupBy("account_id").agg(
        F.max(latest).alias("latest"), F.max("risk_score").alias("max_score"), F.count(F.lit(1)).alias("tx_count"),
        F.count_if("should_block").alias("blocked_count"), F.count_if(risky).alias("high_risk_count"))
    hits = M.flagged(decisions)
    log.append(batch, {"status": status, "flagged": M.flag_times(hits), "reasons": M.flag_codes(hits)})


def account_risk_status(log: MergeLog, batch: int | None = None) -> DataFrame:
    """M5 as of a batch; the columns of ``monitor.account_risk_status``."""
    last = F.col("latest")
    return log.read("status", batch).select(
        "account_id", last["risk_level"].alias("latest_level"), last["risk_score"].alias("latest_score"),
        last["transaction_id"].alias("latest_transaction_id"), "max_score", "tx_count", "blocked_count", "high_risk_count")


def blocked_accounts(log: MergeLog, batch: int | None = None) -> DataFrame:
    """M6 as of a batch; the columns of ``monitor.blocked_accounts``."""
    return M.with_reasons(log.read("flagged", batch), log.read("reasons", batch))
