"""Enrichment joins: features, account type and limits, ML scores.

Broadcast is used only for tables whose size is fixed (the 3-row limits
table); everything else is a
plain join, so Catalyst/AQE pick broadcast or sort-merge from statistics and
split skewed partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .features import ENTITIES, metric_exprs, window_start
from .skew import hot_keys, is_broadcast, salted_join
from .timeline import Trail, attach, occurrences, points, sweep

# Features the rules read: (flat name, entity, metric, window).
RULE_FEATURES = [
    ("acc_total_amount_24h", "account", "acc_total_amount", "24 hours"),
    ("acc_small_tx_count_24h", "account", "acc_small_tx_count", "24 hours"),
    ("ip_unique_cards_1h", "ip", "ip_unique_cards", "1 hour"),
    ("dev_unique_cards_1h", "device", "dev_unique_cards", "1 hour"),
    ("acc_fail_ratio_1h", "account", "acc_fail_ratio", "1 hour"),
    ("card_unique_accounts_24h", "card", "card_unique_accounts", "24 hours"),
]
FEATURE_DEFAULTS = {
    "acc_total_amount_24h": 0, "acc_small_tx_count_24h": 0, "ip_unique_cards_1h": 0,
    "dev_unique_cards_1h": 0, "acc_fail_ratio_1h": 0.0, "card_unique_accounts_24h": 0,
}
_SUFFIX = {"1 hour": "1h", "6 hours": "6h", "24 hours": "24h", "7 days": "7d"}


def limits_table(spark) -> DataFrame:
    """The account-limits dimension (3 rows, fixed)."""
    return spark.createDataFrame(
        config.LIMITS,
        "account_type string, single_tx long, daily_total long, "
        "structuring_threshold long, structuring_count long")


def attach_account_type(tx: DataFrame, accounts: DataFrame, on: str = "account_number") -> DataFrame:
    """J9 (type part): left join the account dimension; unknown -> 'normal'."""
    acc = accounts.select(on, F.col("account_type").alias("_acct_type"))
    out = tx.drop("account_type") if "account_type" in tx.columns else tx
    out = out.join(acc, on=on, how="left")
    return out.withColumn("account_type", F.coalesce(F.col("_acct_type"), F.lit(config.DEFAULT_ACCOUNT_TYPE))) \
              .drop("_acct_type")


def attach_limits(tx: DataFrame) -> DataFrame:
    """J9 (limits part): broadcast join of the fixed 3-row limits table."""
    spark = tx.sparkSession
    lim = F.broadcast(limits_table(spark))
    t = tx if "account_type" in tx.columns else tx.withColumn("account_type", F.lit(config.DEFAULT_ACCOUNT_TYPE))
    return t.join(lim, on="account_type", how="left")


def _tumbling(tx: DataFrame, distinct: str) -> DataFrame:
    """J8 tumbling: join each transaction to the feature rows of the windows it
    falls in: one table for each of the five (entity, window) pairs, joined on
    (key, bucket), the rows of hot keys dealt over salts."""
    need = {}
    for flat, entity, metric, win in RULE_FEATURES:
        need.setdefault((entity, win), []).append((flat, metric))
    on = {(entity, win): [ENTITIES[entity].key, f"_b_{entity}_{_SUFFIX[win]}"] for entity, win in need}
    out = tx.withColumns({bucket: window_start(F.col("event_time"), win) for (_, win), (_, bucket) in on.items()})
    hot = {} if is_broadcast(tx) else hot_keys(out, {bucket: keys for keys in on.values() for bucket in keys[1:]})
    for (entity, win), items in need.items():
        key, bucket = on[entity, win]
        exprs = dict(metric_exprs(entity, distinct))
        feats = (tx.select(key, "event_time", "amount_rial", "result", "card_pan", "account_number")
                   .groupBy(F.col(key), window_start(F.col("event_time"), win).alias(bucket))
                   .agg(*[exprs[m].alias(flat) for flat, m in items]))
        out = salted_join(out, feats, [key, bucket], hot.get(bucket, {})).drop(bucket)
    return out


#: Trailing windows of each entity, and what its transactions add up.
TRAILS = {
    "account": [Trail(86400, {"acc_total_amount_24h": "amount", "acc_small_tx_count_24h": "small"}),
                Trail(3600, {"_failed_1h": "failed", "_n_1h": "n"})],
    "ip": [Trail(3600, distincts={"ip_unique_cards_1h": "card_pan"})],
    "device": [Trail(3600, distincts={"dev_unique_cards_1h": "card_pan"})],
    "card": [Trail(86400, distincts={"card_unique_accounts_24h": "account_number"})],
}


def trail_measures(entity: str) -> dict[str, Column]:
    """Measures of the entity's points."""
    if entity != "account":
        return {"n": F.lit(1).cast("bigint")}
    amt = F.col("amount_rial")
    return {"n": F.lit(1).cast("bigint"), "amount": amt.cast("decimal(28,0)"),
            "small": F.when(amt < config.SMALL_TX_AMOUNT, 1).otherwise(0).cast("bigint"),
            "failed": F.when(F.col("result") == "FAILED", 1).otherwise(0).cast("bigint")}


def trail_values(entity: str) -> list[str]:
    """Columns whose distinct values the entity's trails count."""
    return sorted({v for tr in TRAILS[entity] for v in tr.distincts.values()})


def attach_trails(tx: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """Transactions with the swept features of every entity, joined on (key, time)."""
    out = tx
    for entity, swept in features.items():
        out = attach(out, ENTITIES[entity].key, swept)
    whole = ["acc_total_amount_24h", "acc_small_tx_count_24h", "ip_unique_cards_1h", "dev_unique_cards_1h", "card_unique_accounts_24h"]
    return (out.withColumns({c: F.col(c).cast("long") for c in whole})
               .withColumn("acc_fail_ratio_1h", F.col("_failed_1h").cast("double") / F.col("_n_1h").cast("double"))
               .drop("_failed_1h", "_n_1h"))


def _trailing(tx: DataFrame) -> DataFrame:
    """J8 trailing (W3): point-in-time features over [t - w, t], rows at t
    included: one timeline an entity carries all its windows."""
    swept = {}
    for entity, trails in TRAILS.items():
        key = ENTITIES[entity].key
        occ = {v: occurrences(tx, key, v) for v in trail_values(entity)}
        swept[entity] = sweep(points(tx, key, trail_measures(entity)), occ, trails)
    return attach_trails(tx, swept)


def attach_features(tx: DataFrame, mode: str = "tumbling", distinct: str = "exact") -> DataFrame:
    """Add the flat rule features ``<metric>_<1h|24h>`` to each transaction."""
    if mode == "tumbling":
        return _tumbling(tx, distinct)
    if mode == "trailing":
        return _trailing(tx)
    raise ValueError(mode)


def attach_ml(tx: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Optional ML scores by transaction_id; none -> ml_score 0.0."""
    cols = ["ml_score", "lstm_score", "ae_score", "behavioral_score", "profile_name"]
    if scores is None:
        out = tx
        for c in cols:
            out = out.withColumn(c, F.lit(None).cast("string" if c == "profile_name" else "double"))
    else:
        s = scores.select("transaction_id", *[c for c in cols if c in scores.columns])
        out = tx.join(s, on="transaction_id", how="left")
        for c in cols:
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast("string" if c == "profile_name" else "double"))
    return out.withColumn("ml_score", F.coalesce(F.col("ml_score"), F.lit(0.0)))


def fill_feature_defaults(df: DataFrame) -> DataFrame:
    """missing features read as 0 / 0.0."""
    out = df
    for name, default in FEATURE_DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
        else:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out
