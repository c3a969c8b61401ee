"""Rules R001-R008, rule score and block flag.

Each rule is ``when(condition, alert struct)``; the alert list keeps the rule
order by filtering NULLs out of ``array(r1, ..., r8)``.  The score folds the
severity weights in that order with the cap applied at every step, which is
the same float arithmetic as adding them one by one.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.format import percent_text, thousands
from .enrich import attach_limits, fill_feature_defaults

ALERT_FIELDS = ["rule_code", "severity", "message", "transaction_id", "account_id",
                "card_pan", "amount", "extra"]


def message(code: str, **values: Column) -> Column:
    """Fill a fixed message template; ``{name}`` parts come from ``values``."""
    parts = []
    for piece in re.split(r"(\{[a-z0-9_]+\})", config.MESSAGES[code]):
        if not piece:
            continue
        if piece.startswith("{"):
            parts.append(values[piece[1:-1]].cast("string"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _alert(code: str, severity: Column | str, msg: Column, card: Column | None,
           amount: Column | None, extra: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(code).alias("rule_code"),
        sev.alias("severity"),
        msg.alias("message"),
        F.col("transaction_id").alias("transaction_id"),
        F.col("account_number").alias("account_id"),
        (card if card is not None else F.lit(None).cast("string")).alias("card_pan"),
        (amount.cast("long") if amount is not None else F.lit(None).cast("long")).alias("amount"),
        extra.alias("extra"),
    )


def rule_alerts(df: DataFrame) -> Column:
    """array<struct> of the alerts that fire, in rule order."""
    amt = F.col("amount_rial")
    card = F.col("card_pan")
    daily = F.col("acc_total_amount_24h")
    small = F.col("acc_small_tx_count_24h")
    ipc = F.col("ip_unique_cards_1h")
    devc = F.col("dev_unique_cards_1h")
    fail = F.col("acc_fail_ratio_1h")
    cacc = F.col("card_unique_accounts_24h")
    ratio = amt / F.col("daily_total")
    sev = lambda n, lim: F.when(n >= lim * 2, "high").otherwise("medium")
    r = [
        F.when(amt > F.col("single_tx"), _alert(
            "R001", "high", message("R001", amount=thousands(amt), limit=thousands(F.col("single_tx"))),
            card, amt, F.to_json(F.struct(F.col("single_tx").alias("limit"))))),
        F.when(daily > F.col("daily_total"), _alert(
            "R002", "high", message("R002", daily_total=thousands(daily), limit=thousands(F.col("daily_total"))),
            card, daily, F.to_json(F.struct(F.col("daily_total").alias("limit"), F.lit("24h").alias("window"))))),
        F.when((amt < F.col("structuring_threshold")) & (small >= F.col("structuring_count")), _alert(
            "R003", "high", message("R003", small_count=small),
            card, amt, F.to_json(F.struct(small.alias("small_tx_count"),
                                          F.col("structuring_threshold").alias("threshold"))))),
        F.when(ipc >= config.MULTI_CARD_IP_COUNT, _alert(
            "R004", sev(ipc, config.MULTI_CARD_IP_COUNT),
            message("R004", ip=F.coalesce(F.col("ip_address"), F.lit("None")), unique_cards=ipc),
            card, amt, F.to_json(F.struct(F.col("ip_address").alias("ip"), ipc.alias("unique_cards"))))),
        F.when(devc >= config.MULTI_CARD_DEVICE_COUNT, _alert(
            "R005", sev(devc, config.MULTI_CARD_DEVICE_COUNT),
            message("R005", device8=F.substring(F.coalesce(F.col("device_fp_hash"), F.lit("")), 1, 8),
                    unique_cards=devc),
            card, amt, F.to_json(F.struct(F.col("device_fp_hash").alias("device"), devc.alias("unique_cards"))))),
        F.when(F.coalesce(F.col("is_night"), F.lit(False)) & (ratio >= config.NIGHT_HIGH_AMOUNT_RATIO), _alert(
            "R006", "medium", message("R006", percent=percent_text(ratio)),
            card, amt, F.to_json(F.struct(ratio.alias("night_ratio"))))),
        F.when(fail >= config.FAIL_RATIO_THRESHOLD, _alert(
            "R007", "medium", message("R007", percent=percent_text(fail)),
            None, None, F.to_json(F.struct(fail.alias("fail_ratio"))))),
        F.when(cacc >= config.MULTI_ACCOUNT_CARD_COUNT, _alert(
            "R008", "medium", message("R008", unique_accounts=cacc),
            None, None, F.to_json(F.struct(cacc.alias("unique_accounts"))))),
    ]
    return F.filter(F.array(*r), lambda x: x.isNotNull())


def severity_weight(sev: Column) -> Column:
    w = config.SEVERITY_WEIGHT
    return (F.when(sev == "high", F.lit(w["high"]))
             .when(sev == "medium", F.lit(w["medium"]))
             .otherwise(F.lit(w["low"])))


def rule_score(alerts: Column) -> Column:
    """Capped running sum of severity weights, in alert order."""
    return F.aggregate(alerts, F.lit(0.0), lambda acc, x: F.least(F.lit(1.0), acc + severity_weight(x["severity"])))


def rule_block(alerts: Column) -> Column:
    """Any high alert blocks."""
    return F.exists(alerts, lambda x: x["severity"] == "high")


def evaluate_rules(tx_with_features: DataFrame) -> DataFrame:
    """Add ``alerts``, ``risk_score`` and ``should_block`` to each transaction.

    Input needs the transaction columns, ``account_type`` (optional, default
    normal) and the flat rule features (missing ones count as 0)."""
    df = fill_feature_defaults(tx_with_features)
    if "single_tx" not in df.columns:
        df = attach_limits(df)
    df = df.withColumn("alerts", rule_alerts(df))
    return (df.withColumn("risk_score", rule_score(F.col("alerts")))
              .withColumn("should_block", rule_block(F.col("alerts"))))


def explode_alerts(rule_df: DataFrame) -> DataFrame:
    """Long form: one row per fired alert with its position."""
    return (rule_df.select("transaction_id", F.posexplode("alerts").alias("alert_pos", "a"))
                   .select("transaction_id", "alert_pos", *[F.col("a." + f).alias(f)
                                                            for f in ALERT_FIELDS if f != "transaction_id"]))
