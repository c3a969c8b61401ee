"""Registered queries: ingestion, features, enrichment, rules, decisions.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Computed columns carry the same names on both sides; doubles are rounded
the same way on both sides (averages and std 2 dp, ratios 6 dp) and
timestamps are emitted without a zone.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import network as FN
from ..functions.identity import PERSIAN_DIGITS
from ..operators import features as FE
from ..operators import ingest as IN
from ..operators import rollup as RU
from ..operators.enrich import RULE_FEATURES, attach_features, fill_feature_defaults
from ..operators.rules import explode_alerts
from ..sources import testdata as TD
from . import oracle as O
from .scoring import rule_results, score

NTZ = "timestamp_ntz"


def _ntz(c: str):
    return F.col(c).cast(NTZ).alias(c)


# ---------------------------------------------------------------- ingestion

def _validated(spark: SparkSession, sf: str) -> DataFrame:
    raw = IN.parse_payloads(TD.raw_payloads(spark, sf))
    return IN.validate(raw)


def q_ingest_normalized(spark, sf):
    clean, _ = IN.split(_validated(spark, sf))
    cols = [c for c in IN.NORMALIZED_COLUMNS if c != "ingested_at"]
    return clean.select(_ntz("event_time"), *cols)


def q_ingest_dlq(spark, sf):
    _, dlq = IN.split(_validated(spark, sf))
    return dlq.select("transaction_id", "error", "source")


def q_ingest_stats(spark, sf):
    return IN.ingest_stats(_validated(spark, sf))


def q_ingest_high_water_mark(spark, sf):
    clean, _ = IN.split(_validated(spark, sf))
    return IN.high_water_mark(clean)


def _sql_digits(c: str) -> str:
    return f"regexp_replace(translate({c}, '{PERSIAN_DIGITS}', '0123456789'), '[^0-9]', '', 'g')"


def _sql_nc_valid(d: str) -> str:
    s = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INTEGER) * {10 - i}" for i in range(9))
    s = f"(({s}) % 11)"
    chk = f"CAST(substr({d}, 10, 1) AS INTEGER)"
    return (f"({d} <> repeat(substr({d}, 1, 1), 10) AND "
            f"(({s} < 2 AND {chk} = {s}) OR ({s} >= 2 AND {chk} = 11 - {s})))")


def _ingest_ctes() -> list[str]:
    loc = "((event_time AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran')"
    dashed = " || '-' || ".join(f"substr(card_pan, {1 + 4 * k}, 4)" for k in range(4))
    raw = f"""
raw AS (
  SELECT event_id, transaction_id,
    CASE WHEN event_id % 71 = 0 THEN 'not-a-date' ELSE CASE event_id % 6
      WHEN 0 THEN strftime({loc}, '%Y-%m-%dT%H:%M:%S')
      WHEN 1 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 2 THEN strftime({loc}, '%Y-%m-%dT%H:%M:%S') || '+0330'
      WHEN 3 THEN strftime({loc}, '%Y/%m/%d %H:%M:%S')
      WHEN 4 THEN strftime({loc}, '%Y-%m-%d %H:%M:%S')
      ELSE strftime({loc}, '%d/%m/%Y %H:%M:%S') END END AS ts_text,
    CASE WHEN event_id % 53 = 0 THEN -1 ELSE amount_rial END AS amount_raw,
    CASE WHEN event_id % 50 = 0 THEN '12345' WHEN event_id % 10 = 0 THEN {dashed}
         WHEN event_id % 13 = 0 THEN translate(card_pan, '0123456789', '{PERSIAN_DIGITS}')
         ELSE card_pan END AS card_raw,
    account_number,
    CASE WHEN event_id % 59 = 0
         THEN substr(national_code, 1, 9) || CAST((CAST(substr(national_code, 10, 1) AS INTEGER) + 1) % 10 AS VARCHAR)
         ELSE national_code END AS nc_raw,
    '912' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS mobile_raw,
    CASE WHEN event_id % 61 = 0 THEN '999.999.0.1' ELSE ip_address END AS ip_raw,
    CASE WHEN event_id % 67 = 0 THEN '  ' ELSE device_fingerprint END AS dev_raw,
    channel, result
  FROM tx)"""
    naive = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]
    later_naive = ["%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]
    tz = "timezone('UTC', timezone('Asia/Tehran', {x}))"
    parts = [f"WHEN try_strptime(ts_text, '{f}') IS NOT NULL THEN "
             + tz.format(x=f"try_strptime(ts_text, '{f}')") for f in naive]
    parts.append("WHEN try_strptime(ts_text, '%Y-%m-%dT%H:%M:%S%z') IS NOT NULL THEN "
                 "timezone('UTC', try_strptime(ts_text, '%Y-%m-%dT%H:%M:%S%z'))")
    parts += [f"WHEN try_strptime(ts_text, '{f}') IS NOT NULL THEN "
              + tz.format(x=f"try_strptime(ts_text, '{f}')") for f in later_naive]
    ipv = (f"(regexp_full_match(trim(ip_raw), '{FN.IPV4_PATTERN[1:-1]}') OR "
           f"regexp_full_match(trim(ip_raw), '{FN.IPV6_PATTERN[1:-1]}'))")
    chk = f"""
chk AS (
  SELECT *, {_sql_digits('card_raw')} AS card_d, {_sql_digits('nc_raw')} AS nc_d,
    CASE {' '.join(parts)} END AS utc_ts,
    {ipv} AS ip_ok
  FROM raw)"""
    errs = f"""
errs AS (
  SELECT *, concat_ws('; ',
      CASE WHEN amount_raw <= 0 THEN '(''amount_rial'',): Value error, مبلغ باید مثبت باشه'
           WHEN amount_raw > {config.MAX_AMOUNT_RIAL} THEN '(''amount_rial'',): Value error, مبلغ غیرمعقول: ' || amount_raw END,
      CASE WHEN length(card_d) <> 16 THEN '(''card_pan'',): Value error, card_pan باید ۱۶ رقم باشه، دریافت شد: ' || length(card_d) END,
      CASE WHEN length(nc_d) <> 10 THEN '(''national_code'',): Value error, کد ملی باید ۱۰ رقم باشه'
           WHEN NOT {_sql_nc_valid('nc_d')} THEN '(''national_code'',): Value error, کد ملی ' || nc_d || ' معتبر نیست (checksum)' END,
      CASE WHEN NOT ip_ok THEN '(''ip_address'',): Value error, IP نامعتبر: ' || ip_raw END
    ) AS field_err
  FROM chk),
judged AS (
  SELECT *, CASE
      WHEN field_err <> '' THEN 'ValidationError: ' || field_err
      WHEN trim(transaction_id) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: transaction_id'
      WHEN trim(card_d) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: card_pan'
      WHEN trim(account_number) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: account_number'
      WHEN trim(nc_d) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: national_code'
      WHEN trim(mobile_raw) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: mobile'
      WHEN trim(ip_raw) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: ip_address'
      WHEN trim(dev_raw) = '' THEN 'ValidationError: (): Value error, فیلد اجباری خالیه: device_fingerprint'
      WHEN utc_ts IS NULL THEN 'UnexpectedError: نمی‌تونم timestamp رو parse کنم: ' || ts_text
    END AS error
  FROM errs)"""
    return [raw, chk, errs]


def _sql_ingest(body: str) -> str:
    return O.with_tx(body, *_ingest_ctes())


SQL_INGEST_NORMALIZED = _sql_ingest("""
, loc AS (
  SELECT *, ((utc_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran') AS local_ts,
         CAST(epoch(((utc_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran')) - epoch(utc_ts) AS BIGINT) AS off_s,
         regexp_replace(mobile_raw, '^0+', '') AS mob
  FROM judged WHERE error IS NULL)
SELECT
  utc_ts AS event_time,
  transaction_id,
  strftime(utc_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc,
  strftime(local_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off_s < 0 THEN '-' ELSE '+' END
     || lpad(CAST(abs(off_s) // 3600 AS VARCHAR), 2, '0') || lpad(CAST((abs(off_s) % 3600) // 60 AS VARCHAR), 2, '0') AS timestamp_local,
  amount_raw AS amount_rial,
  card_d AS card_pan,
  substr(card_d, 1, 6) || repeat('x', greatest(length(card_d) - 10, 0)) || substr(card_d, length(card_d) - 3, 4) AS card_pan_masked,
  account_number,
  nc_d AS national_code,
  '+98' || regexp_replace('0' || mobile_raw, '^0+', '') AS mobile_e164,
  '0' || mobile_raw AS mobile_normalized,
  trim(ip_raw) AS ip_address,
  starts_with(trim(ip_raw), '10.') AS is_carrier_nat,
  CASE WHEN starts_with(trim(ip_raw), '10.') THEN 0.3 ELSE 1.0 END::DOUBLE AS ip_confidence,
  dev_raw AS device_fingerprint,
  sha256(dev_raw) AS device_fp_hash,
  CAST(NULL AS VARCHAR) AS user_agent,
  channel,
  result,
  (hour(utc_ts) >= 20 OR hour(utc_ts) < 2) AS is_night
FROM loc""".replace("\n, loc AS", ",\nloc AS", 1))

SQL_INGEST_DLQ = _sql_ingest("""
SELECT transaction_id, error, 'bank_api' AS source FROM judged WHERE error IS NOT NULL""")

SQL_INGEST_STATS = _sql_ingest("""
SELECT count(*) FILTER (WHERE error IS NULL) AS ok, count(*) FILTER (WHERE error IS NOT NULL) AS dlq,
       CAST(1 AS BIGINT) AS batches FROM judged""")

SQL_INGEST_HWM = _sql_ingest("""
SELECT max(strftime(utc_ts, '%Y-%m-%dT%H:%M:%SZ')) AS high_water_mark FROM judged WHERE error IS NULL""")


# ---------------------------------------------------------------- features

_ROUND = {"avg": 2, "std": 2, "ratio": 6}


def _round_kind(name: str) -> int | None:
    if name.endswith("_avg_amount"):
        return 2
    if name.endswith("_std_amount"):
        return 2
    if name.endswith("_ratio"):
        return 6
    return None


def rounded_features(df: DataFrame) -> DataFrame:
    cols = []
    for c in df.columns:
        r = _round_kind(c)
        if c in ("window_start", "window_end"):
            cols.append(_ntz(c))
        elif r is not None:
            cols.append(F.round(F.col(c), r).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _q_features(entity: str):
    def q(spark, sf):
        tx = TD.transactions(spark, sf)
        return rounded_features(FE.entity_features(tx, entity, config.WINDOWS, "exact"))
    return q


_SQL_METRICS = {
    "card": [
        ("card_tx_count", "count(*)"),
        ("card_total_amount", "CAST(sum(amount_rial) AS BIGINT)"),
        ("card_avg_amount", "round(avg(amount_rial), 2)"),
        ("card_std_amount", "round(stddev_samp(amount_rial), 2)"),
        ("card_max_amount", "max(amount_rial)"),
        ("card_min_amount", "min(amount_rial)"),
        ("card_unique_accounts", "count(DISTINCT account_number)"),
        ("card_unique_ips", "count(DISTINCT ip_address)"),
        ("card_unique_devices", "count(DISTINCT device_fp_hash)"),
        ("card_night_ratio", "round(avg(CAST(is_night AS INTEGER)), 6)"),
        ("card_fail_ratio", "round(count(*) FILTER (WHERE result = 'FAILED') / count(*), 6)"),
    ],
    "account": [
        ("acc_tx_count", "count(*)"),
        ("acc_total_amount", "CAST(sum(amount_rial) AS BIGINT)"),
        ("acc_avg_amount", "round(avg(amount_rial), 2)"),
        ("acc_std_amount", "round(stddev_samp(amount_rial), 2)"),
        ("acc_unique_cards", "count(DISTINCT card_pan)"),
        ("acc_unique_mobiles", "count(DISTINCT mobile_e164)"),
        ("acc_unique_ips", "count(DISTINCT ip_address)"),
        ("acc_night_ratio", "round(avg(CAST(is_night AS INTEGER)), 6)"),
        ("acc_small_tx_count", f"count(*) FILTER (WHERE amount_rial < {config.SMALL_TX_AMOUNT})"),
        ("acc_fail_ratio", "round(count(*) FILTER (WHERE result = 'FAILED') / count(*), 6)"),
    ],
    "ip": [
        ("ip_tx_count", "count(*)"),
        ("ip_unique_cards", "count(DISTINCT card_pan)"),
        ("ip_unique_persons", "count(DISTINCT national_code)"),
        ("ip_unique_devices", "count(DISTINCT device_fp_hash)"),
        ("ip_avg_amount", "round(avg(amount_rial), 2)"),
        ("ip_night_ratio", "round(avg(CAST(is_night AS INTEGER)), 6)"),
        ("ip_nat_ratio", "round(avg(CAST(is_carrier_nat AS INTEGER)), 6)"),
    ],
    "device": [
        ("dev_tx_count", "count(*)"),
        ("dev_unique_cards", "count(DISTINCT card_pan)"),
        ("dev_unique_persons", "count(DISTINCT national_code)"),
        ("dev_unique_accounts", "count(DISTINCT account_number)"),
        ("dev_avg_amount", "round(avg(amount_rial), 2)"),
        ("dev_night_ratio", "round(avg(CAST(is_night AS INTEGER)), 6)"),
    ],
}


def sql_features(entity: str) -> str:
    key = FE.ENTITIES[entity].key
    unions = " UNION ALL ".join(
        f"SELECT {key} AS entity_id, '{w}' AS window_duration, {config.WINDOW_SECONDS[w]} AS secs, "
        f"{O.bucket_sql('event_time', config.WINDOW_SECONDS[w])} AS window_start, * FROM tx"
        for w in config.WINDOWS)
    metrics = ",\n  ".join(f"{e} AS {n}" for n, e in _SQL_METRICS[entity])
    return O.with_tx(f"""
, b AS ({unions})
SELECT '{entity}' AS entity_type, entity_id, window_duration, window_start,
  make_timestamp(epoch_us(window_start) + CAST(secs AS BIGINT) * 1000000) AS window_end,
  {metrics}
FROM b GROUP BY entity_id, window_duration, window_start, secs""".replace("\n, b AS", ",\nb AS", 1))


def q_features_all(spark, sf):
    """Every entity and window, rolled up from hourly partials."""
    return rounded_features(RU.all_rolled_up(TD.transactions(spark, sf)))


SQL_FEATURES_ALL = " UNION ALL BY NAME ".join(f"({sql_features(e)})" for e in FE.ENTITIES)


def q_features_json(spark, sf):
    tx = TD.transactions(spark, sf)
    return FE.feature_json(FE.entity_features(tx, "card", config.WINDOWS, "exact"))


def q_features_approx(spark, sf):
    tx = TD.transactions(spark, sf)
    return rounded_features(FE.entity_features(tx, "card", config.WINDOWS, "approx"))


# ---------------------------------------------------------------- enrichment + rules

_FLAT = [f for f, *_ in RULE_FEATURES]


def _flat_select(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", *[
        F.round(F.col(f), 6).alias(f) if f.endswith("ratio_1h") else F.col(f) for f in _FLAT])


def q_tx_features_wide(spark, sf):
    tx = TD.transactions(spark, sf)
    return _flat_select(fill_feature_defaults(attach_features(tx, "tumbling")))


def q_tx_features_trailing(spark, sf):
    tx = TD.transactions(spark, sf)
    return _flat_select(fill_feature_defaults(attach_features(tx, "trailing")))


def _feature_ctes() -> list[str]:
    b1 = O.bucket_sql("event_time", 3600)
    b24 = O.bucket_sql("event_time", 86400)
    return [
        f"txb AS (SELECT *, {b1} AS b1, {b24} AS b24 FROM tx)",
        f"acc24 AS (SELECT account_number, b24, CAST(sum(amount_rial) AS BIGINT) AS acc_total_amount_24h, "
        f"count(*) FILTER (WHERE amount_rial < {config.SMALL_TX_AMOUNT}) AS acc_small_tx_count_24h "
        f"FROM txb GROUP BY account_number, b24)",
        "acc1 AS (SELECT account_number, b1, count(*) FILTER (WHERE result = 'FAILED') / count(*) AS acc_fail_ratio_1h "
        "FROM txb GROUP BY account_number, b1)",
        "ip1 AS (SELECT ip_address, b1, count(DISTINCT card_pan) AS ip_unique_cards_1h FROM txb GROUP BY ip_address, b1)",
        "dev1 AS (SELECT device_fp_hash, b1, count(DISTINCT card_pan) AS dev_unique_cards_1h "
        "FROM txb GROUP BY device_fp_hash, b1)",
        "card24 AS (SELECT card_pan, b24, count(DISTINCT account_number) AS card_unique_accounts_24h "
        "FROM txb GROUP BY card_pan, b24)",
        """txf AS (
  SELECT txb.*,
    coalesce(acc24.acc_total_amount_24h, 0) AS acc_total_amount_24h,
    coalesce(acc24.acc_small_tx_count_24h, 0) AS acc_small_tx_count_24h,
    coalesce(ip1.ip_unique_cards_1h, 0) AS ip_unique_cards_1h,
    coalesce(dev1.dev_unique_cards_1h, 0) AS dev_unique_cards_1h,
    coalesce(acc1.acc_fail_ratio_1h, 0.0) AS acc_fail_ratio_1h,
    coalesce(card24.card_unique_accounts_24h, 0) AS card_unique_accounts_24h
  FROM txb
  LEFT JOIN acc24 ON txb.account_number = acc24.account_number AND txb.b24 = acc24.b24
  LEFT JOIN acc1 ON txb.account_number = acc1.account_number AND txb.b1 = acc1.b1
  LEFT JOIN ip1 ON txb.ip_address = ip1.ip_address AND txb.b1 = ip1.b1
  LEFT JOIN dev1 ON txb.device_fp_hash = dev1.device_fp_hash AND txb.b1 = dev1.b1
  LEFT JOIN card24 ON txb.card_pan = card24.card_pan AND txb.b24 = card24.b24)""",
    ]


def _flat_sql(src: str) -> str:
    return (f"SELECT transaction_id, acc_total_amount_24h, acc_small_tx_count_24h, ip_unique_cards_1h, "
            f"dev_unique_cards_1h, round(acc_fail_ratio_1h, 6) AS acc_fail_ratio_1h, card_unique_accounts_24h "
            f"FROM {src}")


SQL_TX_FEATURES_WIDE = O.with_tx(_flat_sql("txf"), *_feature_ctes())


def _trailing_columns(ratio: str) -> str:
    """The trailing rule features; ``ratio`` wraps the failure ratio."""
    def w(key, secs):
        return (f"OVER (PARTITION BY {key} ORDER BY event_time "
                f"RANGE BETWEEN INTERVAL {secs} SECONDS PRECEDING AND CURRENT ROW)")
    return f"""
  CAST(sum(amount_rial) {w('account_number', 86400)} AS BIGINT) AS acc_total_amount_24h,
  count(*) FILTER (WHERE amount_rial < {config.SMALL_TX_AMOUNT}) {w('account_number', 86400)} AS acc_small_tx_count_24h,
  count(DISTINCT card_pan) {w('ip_address', 3600)} AS ip_unique_cards_1h,
  count(DISTINCT card_pan) {w('device_fp_hash', 3600)} AS dev_unique_cards_1h,
  {ratio.format(f"count(*) FILTER (WHERE result = 'FAILED') {w('account_number', 3600)} / count(*) {w('account_number', 3600)}")}
    AS acc_fail_ratio_1h,
  count(DISTINCT account_number) {w('card_pan', 86400)} AS card_unique_accounts_24h
FROM tx"""


def _trailing_sql() -> str:
    return O.with_tx(f"SELECT transaction_id, {_trailing_columns('round({}, 6)')}")


def _trailing_ctes() -> list[str]:
    """``txf`` as the tumbling features name it, with trailing windows."""
    return [f"txf AS (SELECT tx.*, {_trailing_columns('{}')})"]


def _template_sql(code: str, **values: str) -> str:
    parts = []
    for piece in re.split(r"(\{[a-z0-9_]+\})", config.MESSAGES[code]):
        if not piece:
            continue
        if piece.startswith("{"):
            parts.append(f"CAST({values[piece[1:-1]]} AS VARCHAR)")
        else:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


def _th(x: str) -> str:
    return f"format('{{:,}}', {x})"


def _pct(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR)"


def _alerts_cte() -> str:
    ratio = "(amount_rial / daily_total)"
    sev = "CASE WHEN {n} >= {lim} THEN 'high' ELSE 'medium' END"
    rules = [
        ("R001", "'high'", _template_sql("R001", amount=_th("amount_rial"), limit=_th("single_tx")),
         "amount_rial > single_tx"),
        ("R002", "'high'", _template_sql("R002", daily_total=_th("acc_total_amount_24h"), limit=_th("daily_total")),
         "acc_total_amount_24h > daily_total"),
        ("R003", "'high'", _template_sql("R003", small_count="acc_small_tx_count_24h"),
         "amount_rial < structuring_threshold AND acc_small_tx_count_24h >= structuring_count"),
        ("R004", sev.format(n="ip_unique_cards_1h", lim=2 * config.MULTI_CARD_IP_COUNT),
         _template_sql("R004", ip="ip_address", unique_cards="ip_unique_cards_1h"),
         f"ip_unique_cards_1h >= {config.MULTI_CARD_IP_COUNT}"),
        ("R005", sev.format(n="dev_unique_cards_1h", lim=2 * config.MULTI_CARD_DEVICE_COUNT),
         _template_sql("R005", device8="substr(device_fp_hash, 1, 8)", unique_cards="dev_unique_cards_1h"),
         f"dev_unique_cards_1h >= {config.MULTI_CARD_DEVICE_COUNT}"),
        ("R006", "'medium'", _template_sql("R006", percent=_pct(ratio)),
         f"is_night AND {ratio} >= {config.NIGHT_HIGH_AMOUNT_RATIO}"),
        ("R007", "'medium'", _template_sql("R007", percent=_pct("acc_fail_ratio_1h")),
         f"acc_fail_ratio_1h >= {config.FAIL_RATIO_THRESHOLD}"),
        ("R008", "'medium'", _template_sql("R008", unique_accounts="card_unique_accounts_24h"),
         f"card_unique_accounts_24h >= {config.MULTI_ACCOUNT_CARD_COUNT}"),
    ]
    amount_expr = {"R002": "acc_total_amount_24h", "R007": "NULL", "R008": "NULL"}
    card_expr = {"R007": "NULL", "R008": "NULL"}
    sel = " UNION ALL ".join(
        f"SELECT transaction_id, account_number AS account_id, '{code}' AS rule_code, {s} AS severity, "
        f"{msg} AS message, CAST({amount_expr.get(code, 'amount_rial')} AS DOUBLE) AS amount, "
        f"CAST({card_expr.get(code, 'card_pan')} AS VARCHAR) AS card_pan "
        f"FROM txl WHERE {cond}"
        for code, s, msg, cond in rules)
    return (f"txl AS (SELECT txf.*, limits.single_tx, limits.daily_total, limits.structuring_threshold, "
            f"limits.structuring_count FROM txf JOIN limits USING (account_type)),\n"
            f"alerts AS ({sel}),\n"
            f"alerts_pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY rule_code) - 1 "
            f"AS INTEGER) AS alert_pos, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS sev_rank, "
            f"CASE severity WHEN 'high' THEN {config.SEVERITY_WEIGHT['high']} WHEN 'medium' "
            f"THEN {config.SEVERITY_WEIGHT['medium']} ELSE {config.SEVERITY_WEIGHT['low']} END AS weight FROM alerts)")


def _scoring_sql(body: str, features: list[str] | None = None) -> str:
    return O.with_tx(body, *(features or _feature_ctes()), O.limits_cte(), _alerts_cte())


def q_rule_alerts(spark, sf):
    rr = rule_results(TD.transactions(spark, sf))
    # amount is NULL for account-level rules; emitted as double so that both
    # engines hand the same column type to the comparison.
    return explode_alerts(rr).select("transaction_id", "alert_pos", "rule_code", "severity", "message",
                                     "account_id", "card_pan", F.col("amount").cast("double").alias("amount"))


SQL_RULE_ALERTS = _scoring_sql(
    "SELECT transaction_id, alert_pos, rule_code, severity, message, account_id, card_pan, amount FROM alerts_pos")


def q_rule_results(spark, sf):
    rr = rule_results(TD.transactions(spark, sf))
    return rr.select("transaction_id", F.col("account_number").alias("account_id"), "account_type",
                     F.bround("risk_score", 4).alias("risk_score"), "should_block",
                     F.size("alerts").alias("alert_count"),
                     F.array_join(F.transform("alerts", lambda a: a["rule_code"]), ",").alias("alert_codes"))


SQL_RULE_RESULTS = _scoring_sql("""
, agg AS (SELECT transaction_id, least(1.0, sum(weight)) AS rs, bool_or(severity = 'high') AS blk,
                 count(*) AS n, string_agg(rule_code, ',' ORDER BY rule_code) AS codes
          FROM alerts_pos GROUP BY transaction_id)
SELECT tx.transaction_id, tx.account_number AS account_id, tx.account_type,
       round_even(coalesce(agg.rs, 0.0), 4) AS risk_score, coalesce(agg.blk, false) AS should_block,
       CAST(coalesce(agg.n, 0) AS INTEGER) AS alert_count, coalesce(agg.codes, '') AS alert_codes
FROM tx LEFT JOIN agg USING (transaction_id)""".replace("\n, agg AS", ",\nagg AS", 1))


def _decisions_sql(select: str, features: list[str] | None = None, ml: str = "0.0", scores: str = "") -> str:
    """Decisions; ``ml`` is the model score, of a table that ``scores`` joins."""
    return _scoring_sql(f"""
, agg AS (SELECT transaction_id, least(1.0, sum(weight)) AS rs, bool_or(severity = 'high') AS blk,
                 count(*) AS n,
                 array_to_string(list_slice(list(rule_code || ':' || severity ORDER BY sev_rank, rule_code), 1, {config.TOP_ALERTS}), ',') AS top_codes
          FROM alerts_pos GROUP BY transaction_id),
dec AS (
  SELECT tx.*, least(1.0, round_even(coalesce(agg.rs, 0.0) * {config.RULE_WEIGHT} + coalesce({ml}, 0.0) * {config.ML_WEIGHT}, 4)) AS risk_score,
         round_even(coalesce({ml}, 0.0), 4) AS ml_score,
         coalesce(agg.blk, false) AS rule_block, round_even(coalesce(agg.rs, 0.0), 4) AS rule_score,
         CAST(coalesce(agg.n, 0) AS INTEGER) AS alert_count, coalesce(agg.top_codes, '') AS top_alert_codes
  FROM tx LEFT JOIN agg USING (transaction_id) {scores}),
decided AS (
  SELECT *, CASE WHEN risk_score >= {config.CRITICAL_THRESHOLD} THEN 'critical'
                 WHEN risk_score >= {config.HIGH_THRESHOLD} THEN 'high'
                 WHEN risk_score >= {config.MEDIUM_THRESHOLD} THEN 'medium' ELSE 'low' END AS risk_level,
         (rule_block OR risk_score >= {config.BLOCK_THRESHOLD}) AS should_block
  FROM dec)
{select}""".replace("\n, agg AS", ",\nagg AS", 1), features)


def decisions_frame(spark, sf) -> DataFrame:
    return score(TD.transactions(spark, sf))


def decision_columns(d: DataFrame, *more: str) -> DataFrame:
    return d.select("transaction_id", "account_id", "risk_score", "risk_level", "should_block", "rule_score",
                    "ml_score", "alert_count",
                    F.array_join(F.transform("top_alerts", lambda a: F.concat(a["code"], F.lit(":"), a["severity"])),
                                 ",").alias("top_alert_codes"), *more)


def q_risk_decisions(spark, sf):
    return decision_columns(decisions_frame(spark, sf))


DECISION_COLUMNS = (
    "SELECT transaction_id, account_number AS account_id, risk_score, risk_level, should_block, rule_score, "
    "0.0::DOUBLE AS ml_score, alert_count, top_alert_codes FROM decided")
SQL_RISK_DECISIONS = _decisions_sql(DECISION_COLUMNS)
SQL_TRAILING_DECISIONS = _decisions_sql(DECISION_COLUMNS, _trailing_ctes())


def q_top_alerts(spark, sf):
    d = decisions_frame(spark, sf)
    return (d.select("transaction_id", F.posexplode("top_alerts").alias("rank", "a"))
             .select("transaction_id", "rank", F.col("a.code").alias("code"), F.col("a.severity").alias("severity"),
                     F.col("a.message").alias("message")))


SQL_TOP_ALERTS = _scoring_sql(f"""
, ranked AS (SELECT transaction_id, rule_code AS code, severity, message,
                    CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY sev_rank, rule_code) - 1 AS INTEGER) AS rank
             FROM alerts_pos)
SELECT transaction_id, rank, code, severity, message FROM ranked WHERE rank < {config.TOP_ALERTS}""".replace(
    "\n, ranked AS", ",\nranked AS", 1))


QUERIES = {
    "ingest_normalized": (q_ingest_normalized, SQL_INGEST_NORMALIZED),
    "ingest_dlq": (q_ingest_dlq, SQL_INGEST_DLQ),
    "ingest_stats": (q_ingest_stats, SQL_INGEST_STATS),
    "ingest_high_water_mark": (q_ingest_high_water_mark, SQL_INGEST_HWM),
    "features_card": (_q_features("card"), sql_features("card")),
    "features_account": (_q_features("account"), sql_features("account")),
    "features_ip": (_q_features("ip"), sql_features("ip")),
    "features_device": (_q_features("device"), sql_features("device")),
    "features_all": (q_features_all, SQL_FEATURES_ALL),
    "features_approx": (q_features_approx, None),
    "features_json": (q_features_json, None),
    "tx_features_wide": (q_tx_features_wide, SQL_TX_FEATURES_WIDE),
    "tx_features_trailing": (q_tx_features_trailing, _trailing_sql()),
    "rule_alerts": (q_rule_alerts, SQL_RULE_ALERTS),
    "rule_results": (q_rule_results, SQL_RULE_RESULTS),
    "risk_decisions": (q_risk_decisions, SQL_RISK_DECISIONS),
    "top_alerts": (q_top_alerts, SQL_TOP_ALERTS),
}
