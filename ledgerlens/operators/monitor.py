"""Monitoring tables behind the dashboard.

Inputs are decision frames from ``decision.decide`` (one row per scored
transaction, with ``event_time``).  Global counters are single-stage
aggregates with partial aggregation; the "newest n" tables are
``orderBy(...).limit(n)``, planned as a per-partition top-n plus a final
merge (TakeOrderedAndProject), never a full sort.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.format import thousands


def _newest():
    return [F.col("event_time").desc(), F.col("transaction_id").desc()]


def risk_stats(decisions: DataFrame) -> DataFrame:
    """Total, blocked, block rate in percent (half-even, 1 dp)."""
    return (decisions.agg(F.count(F.lit(1)).alias("total_tx"),
                          F.count_if(F.col("should_block")).alias("blocked"))
                     .withColumn("block_rate", F.bround(F.col("blocked") / F.greatest(F.col("total_tx"), F.lit(1))
                                                        * 100, 1)))


def risk_distribution(decisions: DataFrame) -> DataFrame:
    """A10: count per risk level; all four levels are present, even at 0."""
    counts = decisions.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    levels = decisions.sparkSession.createDataFrame([(lv,) for lv in config.RISK_LEVELS], "risk_level string")
    return (F.broadcast(levels).join(counts, "risk_level", "left")
             .select("risk_level", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def monitor_stats(decisions: DataFrame) -> DataFrame:
    """M1: A9 and A10 in one row (one scan, one aggregate)."""
    lv = F.col("risk_level")
    return (decisions.agg(
                F.count(F.lit(1)).alias("total_tx"),
                F.count_if(F.col("should_block")).alias("blocked"),
                *[F.count_if(lv == x).alias(x) for x in config.RISK_LEVELS])
            .withColumn("block_rate", F.bround(F.col("blocked") / F.greatest(F.col("total_tx"), F.lit(1)) * 100, 1))
            .withColumn("high_or_critical", F.col("high") + F.col("critical")))


def transaction_records(decisions: DataFrame) -> DataFrame:
    """M3: the display record of each decision (alert_count counts the top
    alerts only, as the dashboard does; see SURVEY Q17)."""
    card = F.col("card_pan")
    return decisions.select(
        F.col("transaction_id").alias("id"),
        F.col("account_id").alias("account"),
        F.concat(F.substring(card, 1, 6), F.lit("xxxxxx"), F.substring(card, -4, 4)).alias("card"),
        F.col("amount_rial").alias("amount"),
        thousands(F.col("amount_rial")).alias("amount_fmt"),
        "risk_score", "risk_level",
        F.col("should_block").alias("blocked"),
        "is_night",
        F.col("ip_address").alias("ip"),
        "ip_confidence",
        F.col("account_type").alias("acc_type"),
        F.col("top_alerts").alias("alerts"),
        F.size("top_alerts").alias("alert_count"),
        "rule_score", "ml_score",
        F.date_format("event_time", "HH:mm:ss").alias("time"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
        "event_time", "transaction_id",
    )


def recent_transactions(decisions: DataFrame, n: int = config.RECENT_TX_LIMIT) -> DataFrame:
    """K4: newest ``n`` display records."""
    return transaction_records(decisions).orderBy(*_newest()).limit(n)


def alert_feed(decisions: DataFrame, n: int = config.ALERT_FEED_LIMIT) -> DataFrame:
    """K5 / M4: top alerts exploded with transaction id and time; newest ``n``."""
    ex = decisions.select("transaction_id", "event_time", F.posexplode("top_alerts").alias("pos", "a"))
    return (ex.select("transaction_id", "event_time", "pos", F.col("a.code").alias("code"),
                      F.col("a.severity").alias("severity"), F.col("a.message").alias("message"),
                      F.date_format("event_time", "HH:mm:ss").alias("time"))
              .orderBy(F.col("event_time").desc(), F.col("transaction_id").desc(), F.col("pos").desc())
              .limit(n))


def risk_timeline(decisions: DataFrame, n: int = config.TIMELINE_LIMIT) -> DataFrame:
    """K6 / M2: (score, level) of the newest ``n`` decisions."""
    return (decisions.select("transaction_id", "event_time", "risk_score", "risk_level")
                     .orderBy(*_newest()).limit(n))


def account_risk_status(decisions: DataFrame) -> DataFrame:
    """M5: per account the latest decision's level and score, the highest
    score, and counts.  ``max_by`` keeps it one partial aggregate."""
    order = F.struct("event_time", "transaction_id")
    return decisions.groupBy("account_id").agg(
        F.max_by("risk_level", order).alias("latest_level"),
        F.max_by("risk_score", order).alias("latest_score"),
        F.max_by("transaction_id", order).alias("latest_transaction_id"),
        F.max("risk_score").alias("max_score"),
        F.count(F.lit(1)).alias("tx_count"),
        F.count_if(F.col("should_block")).alias("blocked_count"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_count"),
    )


def flagged(decisions: DataFrame) -> DataFrame:
    """The decisions that flag their account: blocked, high or critical."""
    return decisions.filter(F.col("should_block") | F.col("risk_level").isin("high", "critical"))


def flag_times(hits: DataFrame) -> DataFrame:
    """Per account of flagging decisions: how many, the first and the last."""
    return hits.groupBy("account_id").agg(F.count(F.lit(1)).alias("flagged_count"),
                                          F.min("event_time").alias("first_flagged"),
                                          F.max("event_time").alias("last_flagged"))


def flag_codes(hits: DataFrame) -> DataFrame:
    """The distinct (account, alert code) of flagging decisions."""
    codes = F.transform("top_alerts", lambda a: a["code"])
    return hits.select("account_id", F.explode(codes).alias("code")).distinct()


def with_reasons(times: DataFrame, codes: DataFrame) -> DataFrame:
    per_account = codes.groupBy("account_id").agg(F.sort_array(F.collect_set("code")).alias("reasons"))
    none = F.array().cast("array<string>")
    return times.join(per_account, "account_id", "left").withColumn("reasons", F.coalesce("reasons", none))


def blocked_accounts(decisions: DataFrame) -> DataFrame:
    """M6: accounts with a high/critical or blocked decision, with the
    distinct alert codes behind them and first/last flag time."""
    hits = flagged(decisions)
    return with_reasons(flag_times(hits), flag_codes(hits))


def account_holders(tx: DataFrame) -> DataFrame:
    """M7: holder identifiers seen behind each account (distinct national
    codes, mobiles and cards).  Distinct values are found with a partial
    aggregation on (account, value) before the per-account lists are built."""
    parts = []
    for kind, col in [("national_code", "national_code"), ("mobile", "mobile_normalized"), ("card", "card_pan")]:
        parts.append(tx.select("account_number", F.lit(kind).alias("kind"), F.col(col).alias("value")))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("value").isNotNull()).distinct()
    g = u.groupBy("account_number").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k + "s")
          for k in ("national_code", "mobile", "card")])
    return g


def decision_lookup(decisions: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Newest decision for each requested id; ids without a decision
    are absent (the "not found" case)."""
    spark = decisions.sparkSession
    want = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "transaction_id string")
    order = F.struct("event_time", "decided_at")
    hit = decisions.join(want.select("transaction_id").distinct(), "transaction_id", "left_semi")
    cols = [c for c in hit.columns if c != "transaction_id"]
    latest = hit.groupBy("transaction_id").agg(F.max_by(F.struct(*cols), order).alias("d"))
    return latest.select("transaction_id", "d.*")
