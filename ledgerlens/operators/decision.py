"""Final decision: combine rule and ML scores, level, block, top alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .enrich import attach_ml


def severity_rank(sev: Column) -> Column:
    r = config.SEVERITY_RANK
    return (F.when(sev == "high", F.lit(r["high"]))
             .when(sev == "medium", F.lit(r["medium"]))
             .when(sev == "low", F.lit(r["low"]))
             .otherwise(F.lit(9)))


def top_alerts(alerts: Column, n: int = config.TOP_ALERTS) -> Column:
    """K1: stable sort by severity (high, medium, low), first ``n``, keep
    code, severity, message.  Runs inside the row: no shuffle."""
    keyed = F.transform(alerts, lambda x, i: F.struct(
        severity_rank(x["severity"]).alias("r"), i.alias("i"),
        x["rule_code"].alias("code"), x["severity"].alias("severity"), x["message"].alias("message")))
    ranked = F.slice(F.array_sort(keyed), 1, n)
    return F.transform(ranked, lambda x: F.struct(x["code"].alias("code"), x["severity"].alias("severity"),
                                                  x["message"].alias("message")))


def risk_level(score: Column) -> Column:
    """D2 on the rounded score."""
    return (F.when(score >= config.CRITICAL_THRESHOLD, "critical")
             .when(score >= config.HIGH_THRESHOLD, "high")
             .when(score >= config.MEDIUM_THRESHOLD, "medium")
             .otherwise("low"))


def decide(rule_df: DataFrame, ml_df: DataFrame | None = None) -> DataFrame:
    """One decision record per transaction.

    ``rule_df`` carries transaction_id, account_number, risk_score (rule),
    should_block (rule) and alerts; ``ml_df`` optional ML scores by id."""
    df = attach_ml(rule_df, ml_df) if "ml_score" not in rule_df.columns else rule_df
    rule = F.col("risk_score")
    ml = F.coalesce(F.col("ml_score"), F.lit(0.0))
    final = F.least(F.lit(1.0), F.bround(rule * config.RULE_WEIGHT + ml * config.ML_WEIGHT, 4))
    return df.select(
        "transaction_id",
        F.col("account_number").alias("account_id"),
        *[c for c in ("event_time", "account_type", "amount_rial", "card_pan", "ip_address",
                      "ip_confidence", "is_night") if c in df.columns],
        final.alias("risk_score"),
        risk_level(final).alias("risk_level"),
        (F.col("should_block") | (final >= config.BLOCK_THRESHOLD)).alias("should_block"),
        F.bround(rule, 4).alias("rule_score"),
        F.bround(ml, 4).alias("ml_score"),
        F.col("lstm_score").cast("double").alias("lstm_score"),
        F.col("ae_score").cast("double").alias("ae_score"),
        F.col("behavioral_score").cast("double").alias("behavioral_score"),
        F.col("profile_name").cast("string").alias("profile_name"),
        F.size("alerts").alias("alert_count"),
        top_alerts(F.col("alerts")).alias("top_alerts"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("decided_at"),
    )


def decision_json(decisions: DataFrame) -> DataFrame:
    """S7 payload: the 14-field record as JSON text."""
    fields = ["transaction_id", "account_id", "risk_score", "risk_level", "should_block", "rule_score",
              "ml_score", "lstm_score", "ae_score", "behavioral_score", "profile_name", "alert_count",
              "top_alerts", "decided_at"]
    return decisions.select(F.col("transaction_id").alias("key"),
                            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
