"""Window features rolled up from mergeable hourly partials.

Every window length is a whole number of hours and starts on one, so the
features of all windows follow from one partial a key and hour: counts, sums,
extremes and exact first and second moments, and the distinct (key, hour,
column, value) rows.  The transactions are aggregated once, to the hour; the
windows are made from the partials.  Partials merge by adding, so batches of a
stream roll up the same way (``streaming.rollups``).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from .features import ENTITIES, window_end, window_start

BIG = "decimal(38,0)"
#: Columns whose distinct values each entity counts, by output name.
DISTINCT = {
    "card": {"card_unique_accounts": "account_number", "card_unique_ips": "ip_address", "card_unique_devices": "device_fp_hash"},
    "account": {"acc_unique_cards": "card_pan", "acc_unique_mobiles": "mobile_e164", "acc_unique_ips": "ip_address"},
    "ip": {"ip_unique_cards": "card_pan", "ip_unique_persons": "national_code", "ip_unique_devices": "device_fp_hash"},
    "device": {"dev_unique_cards": "card_pan", "dev_unique_persons": "national_code", "dev_unique_accounts": "account_number"},
}
SUMS = {"n": "bigint", "amounts": "bigint", "s1": BIG, "s2": BIG, "nights": "bigint", "night_known": "bigint", "failed": "bigint",
        "small": "bigint", "nats": "bigint", "nat_known": "bigint"}
PARTIAL = "entity_id string, hour timestamp, " + ", ".join(f"{n} {t}" for n, t in SUMS.items()) + ", low bigint, high bigint"
VALUES = "entity_id string, hour timestamp, kind string, value string"


def needed(entity: str) -> list[str]:
    """The columns of a transaction that the partials and values of an entity are made from."""
    return list(dict.fromkeys([ENTITIES[entity].key, "event_time", "amount_rial", "is_night", "result", "is_carrier_nat",
                               *DISTINCT[entity].values()]))


def merged(partials: DataFrame, keys: list[str], also: list[Column] = ()) -> DataFrame:
    """Partials added up by ``keys``."""
    return partials.groupBy(*keys).agg(*[F.sum(n).cast(t).alias(n) for n, t in SUMS.items()], F.min("low").alias("low"),
                                       F.max("high").alias("high"), *also)


def hourly(tx: DataFrame, entity: str, also: list[Column] = ()) -> DataFrame:
    """One partial a key and hour, with further aggregates of ``event_time``."""
    amount = F.col("amount_rial").cast("bigint")
    wide = amount.cast("decimal(19,0)")

    def one(condition):
        return F.when(condition, 1).otherwise(0)
    each = {"n": F.lit(1), "amounts": one(amount.isNotNull()), "s1": wide, "s2": wide * wide, "nights": one(F.col("is_night")),
            "night_known": one(F.col("is_night").isNotNull()), "failed": one(F.col("result") == "FAILED"),
            "small": one(amount < config.SMALL_TX_AMOUNT), "nats": one(F.col("is_carrier_nat")),
            "nat_known": one(F.col("is_carrier_nat").isNotNull())}
    rows = tx.select(F.col(ENTITIES[entity].key).alias("entity_id"), window_start(F.col("event_time"), "1 hour").alias("hour"),
                     *[e.cast(SUMS[n]).alias(n) for n, e in each.items()], amount.alias("low"), amount.alias("high"), "event_time")
    return merged(rows, ["entity_id", "hour"], also)


def hourly_values(tx: DataFrame, entity: str) -> DataFrame:
    """The distinct values of a key and hour, of every column that counts."""
    columns = DISTINCT[entity].values()
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return (tx.select(F.col(ENTITIES[entity].key).alias("entity_id"), window_start(F.col("event_time"), "1 hour").alias("hour"), F.inline(pairs))
              .where("value is not null").distinct())


def in_windows(hours: DataFrame, windows: list[str]) -> DataFrame:
    """Every hourly row once for each window that holds it."""
    each = F.array(*[F.struct(F.lit(w).alias("window_duration"), window_start(F.col("hour"), w).alias("window_start")) for w in windows])
    return hours.select("*", F.inline(each)).drop("hour")


def firsts(values: DataFrame, entity: str, windows: list[str]) -> DataFrame:
    """For each key and hour how many values of a column are new in the window
    of each length there (``<name>_<place of the window>``).  A value is new where
    its hour before lies in another window, so these numbers add up to the
    distinct counts of the windows, and no value is repeated for each of them.
    Repeated rows are new once."""
    before = F.lag("hour").over(Window.partitionBy("entity_id", "kind", "value").orderBy("hour"))
    new = [F.col("before").isNull() | (window_start(F.col("before"), w) != window_start(F.col("hour"), w)) for w in windows]
    return values.withColumn("before", before).groupBy("entity_id", "hour").agg(
        *[F.count_if((F.col("kind") == c) & is_new).alias(f"{n}_{i}") for n, c in DISTINCT[entity].items() for i, is_new in enumerate(new)])


def metrics(entity: str) -> dict[str, Column]:
    """Output name -> expression over merged partials and distinct counts."""
    n, m = F.col("n"), F.col("amounts")
    # sum of squares around the whole number below the mean: exact, without cancellation
    rest = F.pmod(F.col("s1"), F.greatest(m, F.lit(1)).cast("decimal(20,0)")).cast("decimal(20,0)")
    below = ((F.col("s1") - rest) / F.greatest(m, F.lit(1))).cast("decimal(19,0)")
    around = (F.col("s2") - F.lit(2).cast("decimal(2,0)") * below * F.col("s1") + m.cast("decimal(20,0)") * below * below).cast("double")
    std = F.when(m > 1, F.sqrt((around - rest.cast("double") * rest.cast("double") / m) / (m - 1)))
    total = F.when(m > 0, F.col("s1").cast("bigint"))
    mean = F.when(m > 0, F.col("s1").cast("double") / m)
    night = F.when(F.col("night_known") > 0, F.col("nights") / F.col("night_known"))
    failed = F.col("failed") / n
    nat = F.when(F.col("nat_known") > 0, F.col("nats") / F.col("nat_known"))
    counts = {name: F.coalesce(F.col(name), F.lit(0)) for name in DISTINCT[entity]}
    if entity == "card":
        return {"card_tx_count": n, "card_total_amount": total, "card_avg_amount": mean, "card_std_amount": std, "card_max_amount": F.col("high"),
                "card_min_amount": F.col("low"), **counts, "card_night_ratio": night, "card_fail_ratio": failed}
    if entity == "account":
        return {"acc_tx_count": n, "acc_total_amount": total, "acc_avg_amount": mean, "acc_std_amount": std, **counts,
                "acc_night_ratio": night, "acc_small_tx_count": F.col("small"), "acc_fail_ratio": failed}
    if entity == "ip":
        return {"ip_tx_count": n, **counts, "ip_avg_amount": mean, "ip_night_ratio": night, "ip_nat_ratio": nat}
    return {"dev_tx_count": n, **counts, "dev_avg_amount": mean, "dev_night_ratio": night}


def rolled_up(partials: DataFrame, values: DataFrame, entity: str, windows: list[str] | None = None,
              only: DataFrame | None = None) -> DataFrame:
    """Features of every key and window from hourly partials and values; with
    ``only`` (entity_id, window_duration, window_start) of those windows."""
    windows = windows or config.WINDOWS
    keys = ["entity_id", "window_duration", "window_start"]

    def wanted(df, these):
        same = reduce(Column.__and__, [df[k].eqNullSafe(these[k]) for k in these.columns])
        return df.join(these, same, "left_semi")

    def of_window(name):
        return F.coalesce(*[F.when(F.col("window_duration") == w, F.col(f"{name}_{i}")) for i, w in enumerate(windows)])
    if only is not None:
        values = wanted(values, only.select("entity_id").distinct())
    rows = in_windows(partials.unionByName(firsts(values, entity, windows), allowMissingColumns=True), windows)
    out = merged(rows if only is None else wanted(rows, only.select(*keys)), keys, [F.sum(of_window(n)).alias(n) for n in DISTINCT[entity]])
    end = reduce(lambda rest, w: F.when(F.col("window_duration") == w, window_end(F.col("window_start"), w)).otherwise(rest), windows,
                 F.lit(None).cast("timestamp"))
    return out.select(F.lit(ENTITIES[entity].name).alias("entity_type"), *keys, end.alias("window_end"),
                      *[e.alias(n) for n, e in metrics(entity).items()])


def all_rolled_up(tx: DataFrame, windows: list[str] | None = None) -> DataFrame:
    """Every entity and window in one table; metrics of other entities are
    NULL."""
    parts = [rolled_up(hourly(tx, e), hourly_values(tx, e), e, windows) for e in ENTITIES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
