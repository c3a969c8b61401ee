"""Windowed behaviour features per card, account, IP and device.

Batch jobs compute all requested windows of one entity in a single
aggregation: each transaction is assigned to its bucket of every window
(epoch-aligned tumbling windows, the same buckets as ``window()``) and one
``groupBy(key, window)`` with partial (map-side) aggregation does the rest.
Hot keys are harmless here: every aggregate, exact distinct counts included,
is combined map-side before the shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


@dataclass(frozen=True)
class Entity:
    name: str        # entity_type value
    key: str         # grouping column
    prefix: str      # metric name prefix


ENTITIES = {
    "card": Entity("card", "card_pan", "card"),
    "account": Entity("account", "account_number", "acc"),
    "ip": Entity("ip", "ip_address", "ip"),
    "device": Entity("device", "device_fp_hash", "dev"),
}


def distinct_count(c: str, mode: str) -> Column:
    """Distinct counting modes (see SURVEY 2.5)."""
    if mode == "exact":
        return F.countDistinct(c)
    if mode == "approx":
        return F.approx_count_distinct(c)
    if mode == "approx01":
        return F.approx_count_distinct(c, 0.01)
    if mode == "sketch":
        return F.hll_sketch_estimate(F.hll_sketch_agg(c))
    if mode == "set":
        return F.size(F.collect_set(c)).cast("long")
    raise ValueError(f"unknown distinct mode {mode!r}")


def _night() -> Column:
    return F.avg(F.col("is_night").cast("int"))


def _fail_ratio() -> Column:
    return F.count(F.when(F.col("result") == "FAILED", 1)) / F.count(F.lit(1))


def metric_exprs(entity: str, distinct: str = "exact") -> list[tuple[str, Column]]:
    """(name, aggregate) in output order for one entity."""
    amt = F.col("amount_rial")
    d = lambda c: distinct_count(c, distinct)
    if entity == "card":
        return [
            ("card_tx_count", F.count(F.lit(1))),
            ("card_total_amount", F.sum(amt)),
            ("card_avg_amount", F.avg(amt)),
            ("card_std_amount", F.stddev(amt)),
            ("card_max_amount", F.max(amt)),
            ("card_min_amount", F.min(amt)),
            ("card_unique_accounts", d("account_number")),
            ("card_unique_ips", d("ip_address")),
            ("card_unique_devices", d("device_fp_hash")),
            ("card_night_ratio", _night()),
            ("card_fail_ratio", _fail_ratio()),
        ]
    if entity == "account":
        return [
            ("acc_tx_count", F.count(F.lit(1))),
            ("acc_total_amount", F.sum(amt)),
            ("acc_avg_amount", F.avg(amt)),
            ("acc_std_amount", F.stddev(amt)),
            ("acc_unique_cards", d("card_pan")),
            ("acc_unique_mobiles", d("mobile_e164")),
            ("acc_unique_ips", d("ip_address")),
            ("acc_night_ratio", _night()),
            ("acc_small_tx_count", F.count(F.when(amt < config.SMALL_TX_AMOUNT, 1))),
            ("acc_fail_ratio", _fail_ratio()),
        ]
    if entity == "ip":
        return [
            ("ip_tx_count", F.count(F.lit(1))),
            ("ip_unique_cards", d("card_pan")),
            ("ip_unique_persons", d("national_code")),
            ("ip_unique_devices", d("device_fp_hash")),
            ("ip_avg_amount", F.avg(amt)),
            ("ip_night_ratio", _night()),
            ("ip_nat_ratio", F.avg(F.col("is_carrier_nat").cast("int"))),
        ]
    if entity == "device":
        return [
            ("dev_tx_count", F.count(F.lit(1))),
            ("dev_unique_cards", d("card_pan")),
            ("dev_unique_persons", d("national_code")),
            ("dev_unique_accounts", d("account_number")),
            ("dev_avg_amount", F.avg(amt)),
            ("dev_night_ratio", _night()),
        ]
    raise ValueError(entity)


def window_start(ts: Column, win: str) -> Column:
    """Epoch-aligned bucket start of ``ts`` for a tumbling window (UTC)."""
    sec = config.WINDOW_SECONDS[win]
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(sec * 1_000_000)))


def window_end(start: Column, win: str) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.lit(config.WINDOW_SECONDS[win] * 1_000_000))


def _needed_columns(entity: str) -> list[str]:
    base = ["event_time", "amount_rial", "is_night", "result", "is_carrier_nat"]
    extra = {"card": ["account_number", "ip_address", "device_fp_hash"],
             "account": ["card_pan", "mobile_e164", "ip_address"],
             "ip": ["card_pan", "national_code", "device_fp_hash"],
             "device": ["card_pan", "national_code", "account_number"]}[entity]
    return [ENTITIES[entity].key] + base + extra


def entity_features(tx: DataFrame, entity: str, windows: list[str] | None = None,
                    distinct: str = "exact", metrics: list[str] | None = None) -> DataFrame:
    """Long feature table for one entity over several tumbling windows.

    Output: entity_type, entity_id, window_duration, window_start, window_end,
    then the metrics.  One scan and one aggregation for all windows.
    """
    windows = windows or config.WINDOWS
    ent = ENTITIES[entity]
    exprs = metric_exprs(entity, distinct)
    if metrics is not None:
        exprs = [(n, e) for n, e in exprs if n in metrics]
    cols = [c for c in dict.fromkeys(_needed_columns(entity)) if c in tx.columns]
    buckets = F.explode(F.array(*[
        F.struct(F.lit(w).alias("window_duration"), window_start(F.col("event_time"), w).alias("window_start"))
        for w in windows]))
    exploded = tx.select(*cols).select("*", buckets.alias("_w")).select("*", "_w.*").drop("_w")
    agg = (exploded.groupBy(F.col(ent.key).alias("entity_id"), "window_duration", "window_start")
                   .agg(*[e.alias(n) for n, e in exprs]))
    end = F.timestamp_micros(F.unix_micros("window_start") + F.when(
        F.col("window_duration") == "1 hour", F.lit(3600 * 1_000_000)).when(
        F.col("window_duration") == "6 hours", F.lit(21600 * 1_000_000)).when(
        F.col("window_duration") == "24 hours", F.lit(86400 * 1_000_000)).otherwise(
        F.lit(604800 * 1_000_000)))
    return agg.select(F.lit(ent.name).alias("entity_type"), "entity_id", "window_duration",
                      "window_start", end.alias("window_end"), *[n for n, _ in exprs])


def window_features(tx: DataFrame, entity: str, win: str, distinct: str = "approx",
                    watermark: str | None = None) -> DataFrame:
    """One entity x one window with ``window()`` (the form the stream uses).

    Output keeps the ``window`` struct and adds window_duration, entity_type,
    entity_id, like the feature records of the reproduced system.
    """
    ent = ENTITIES[entity]
    df = tx.withWatermark("event_time", watermark) if watermark else tx
    exprs = metric_exprs(entity, distinct)
    return (df.groupBy(F.col(ent.key), F.window("event_time", win))
              .agg(*[e.alias(n) for n, e in exprs])
              .withColumn("window_duration", F.lit(win))
              .withColumn("entity_type", F.lit(ent.name))
              .withColumn("entity_id", F.col(ent.key)))


def card_features(tx: DataFrame, win: str, distinct: str = "approx", watermark: str | None = None) -> DataFrame:
    """A1."""
    return window_features(tx, "card", win, distinct, watermark)


def account_features(tx: DataFrame, win: str, distinct: str = "approx", watermark: str | None = None) -> DataFrame:
    """A2."""
    return window_features(tx, "account", win, distinct, watermark)


def ip_features(tx: DataFrame, win: str, distinct: str = "approx", watermark: str | None = None) -> DataFrame:
    """A3."""
    return window_features(tx, "ip", win, distinct, watermark)


def device_features(tx: DataFrame, win: str, distinct: str = "approx", watermark: str | None = None) -> DataFrame:
    """A4."""
    return window_features(tx, "device", win, distinct, watermark)


def feature_json(features: DataFrame) -> DataFrame:
    """One JSON ``value`` per feature row: entity_type, entity_id,
    window_duration, window_start, window_end, then every metric.  NULL
    metrics are left out of the JSON (``to_json`` drops them)."""
    lead = ["entity_type", "entity_id", "window_duration"]
    if "window" in features.columns:
        start, end = F.col("window.start"), F.col("window.end")
    else:
        start, end = F.col("window_start"), F.col("window_end")
    skip = set(lead) | {"window", "window_start", "window_end"}
    rest = [c for c in features.columns if c not in skip]
    return features.select(F.to_json(F.struct(
        *[F.col(c) for c in lead], start.alias("window_start"), end.alias("window_end"),
        *[F.col(c) for c in rest])).alias("value"))


def all_features(tx: DataFrame, windows: list[str] | None = None, distinct: str = "exact") -> DataFrame:
    """Every entity x every window in one long table (metrics of other
    entities are NULL).  The transaction input is read once per entity."""
    out = None
    for entity in ENTITIES:
        f = entity_features(tx, entity, windows, distinct)
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
