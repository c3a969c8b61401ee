"""Registered queries: monitoring tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import monitor as M
from ..sources import testdata as TD
from ..session import scratch_path
from ..streaming.sinks import BatchSink, write_decisions
from . import q_core
from .q_core import _decisions_sql

NTZ = "timestamp_ntz"


def decisions_frame(spark, sf):
    """The decisions sink of the batch job: scored and committed once, then
    read back by every monitoring query."""
    sink = BatchSink(spark, scratch_path(spark, f"decisions-{TD._fingerprint(spark, sf)}"))
    if not sink.batches():
        write_decisions(sink, 0, q_core.decisions_frame(spark, sf))
    return sink.read().drop("batch")


def _codes(col):
    return F.array_join(F.transform(col, lambda a: F.concat(a["code"], F.lit(":"), a["severity"])), ",")


def q_monitor_stats(spark, sf):
    return M.monitor_stats(decisions_frame(spark, sf))


def q_risk_distribution(spark, sf):
    return M.risk_distribution(decisions_frame(spark, sf))


def _records(df):
    return df.select("id", "account", "card", "amount", "amount_fmt", "risk_score", "risk_level", "blocked",
                     "is_night", "ip", "ip_confidence", "acc_type", _codes(F.col("alerts")).alias("alert_codes"),
                     F.col("alert_count").cast("long").alias("alert_count"), "rule_score", "ml_score", "time",
                     F.col("event_time").cast(NTZ).alias("event_time"))


def q_transaction_records(spark, sf):
    return _records(M.transaction_records(decisions_frame(spark, sf)))


def q_recent_transactions(spark, sf):
    return _records(M.recent_transactions(decisions_frame(spark, sf)))


def q_alert_feed(spark, sf):
    f = M.alert_feed(decisions_frame(spark, sf))
    return f.select("transaction_id", F.col("event_time").cast(NTZ).alias("event_time"), "pos", "code",
                    "severity", "message", "time")


def q_risk_timeline(spark, sf):
    t = M.risk_timeline(decisions_frame(spark, sf))
    return t.select("transaction_id", F.col("event_time").cast(NTZ).alias("event_time"), "risk_score", "risk_level")


def q_account_risk_status(spark, sf):
    return M.account_risk_status(decisions_frame(spark, sf))


def _blocked(b):
    return b.select("account_id", "flagged_count", F.col("first_flagged").cast(NTZ).alias("first_flagged"),
                    F.col("last_flagged").cast(NTZ).alias("last_flagged"),
                    F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), ",").alias("reasons"))


def q_blocked_accounts(spark, sf):
    return _blocked(M.blocked_accounts(decisions_frame(spark, sf)))


def q_account_holders(spark, sf):
    h = M.account_holders(TD.transactions(spark, sf))
    out = [F.col("account_number")]
    for k in ("national_codes", "mobiles", "cards"):
        out += [F.size(k).cast("long").alias("n_" + k), F.array_join(k, ",").alias(k)]
    return h.select(*out)


def q_decision_lookup(spark, sf):
    d = decisions_frame(spark, sf)
    ids = TD.transactions(spark, sf).select("transaction_id")
    r = M.decision_lookup(d, ids)
    return r.select("transaction_id", "account_id", "risk_score", "risk_level", "should_block", "alert_count")


_TOP = f"""
top AS (SELECT * FROM (SELECT transaction_id, rule_code AS code, severity, message,
          CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY sev_rank, rule_code) - 1 AS INTEGER) AS pos
          FROM alerts_pos) WHERE pos < {config.TOP_ALERTS})"""

SQL_MONITOR_STATS = _decisions_sql(f"""
SELECT count(*) AS total_tx, count(*) FILTER (WHERE should_block) AS blocked,
  {", ".join(f"count(*) FILTER (WHERE risk_level = '{x}') AS {x}" for x in config.RISK_LEVELS)},
  round_even(count(*) FILTER (WHERE should_block) / greatest(count(*), 1) * 100, 1) AS block_rate,
  count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_or_critical
FROM decided""")

SQL_RISK_DISTRIBUTION = _decisions_sql(f"""
SELECT l.risk_level, coalesce(c.n, 0) AS n
FROM (VALUES {", ".join(f"('{x}')" for x in config.RISK_LEVELS)}) AS l(risk_level)
LEFT JOIN (SELECT risk_level, count(*) AS n FROM decided GROUP BY risk_level) c USING (risk_level)""")

_RECORDS = """
SELECT transaction_id AS id, account_number AS account,
  substr(card_pan, 1, 6) || 'xxxxxx' || substr(card_pan, length(card_pan) - 3, 4) AS card,
  amount_rial AS amount, format('{:,}', amount_rial) AS amount_fmt, risk_score, risk_level,
  should_block AS blocked, is_night, ip_address AS ip, ip_confidence, account_type AS acc_type,
  top_alert_codes AS alert_codes, CAST(least(alert_count, 5) AS BIGINT) AS alert_count, rule_score,
  0.0::DOUBLE AS ml_score, strftime(event_time, '%H:%M:%S') AS time, event_time
FROM decided"""

SQL_TRANSACTION_RECORDS = _decisions_sql(_RECORDS)
SQL_RECENT_TRANSACTIONS = _decisions_sql(
    _RECORDS + f" ORDER BY event_time DESC, transaction_id DESC LIMIT {config.RECENT_TX_LIMIT}")

SQL_ALERT_FEED = _decisions_sql(f"""
, {_TOP.strip()}
SELECT top.transaction_id, tx.event_time, top.pos, top.code, top.severity, top.message,
       strftime(tx.event_time, '%H:%M:%S') AS time
FROM top JOIN tx USING (transaction_id)
ORDER BY tx.event_time DESC, top.transaction_id DESC, top.pos DESC LIMIT {config.ALERT_FEED_LIMIT}""")

SQL_RISK_TIMELINE = _decisions_sql(f"""
SELECT transaction_id, event_time, risk_score, risk_level FROM decided
ORDER BY event_time DESC, transaction_id DESC LIMIT {config.TIMELINE_LIMIT}""")

ACCOUNT_RISK_STATUS = """
SELECT account_number AS account_id,
  arg_max(risk_level, (event_time, transaction_id)) AS latest_level,
  arg_max(risk_score, (event_time, transaction_id)) AS latest_score,
  arg_max(transaction_id, (event_time, transaction_id)) AS latest_transaction_id,
  max(risk_score) AS max_score, count(*) AS tx_count,
  count(*) FILTER (WHERE should_block) AS blocked_count,
  count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk_count
FROM decided GROUP BY account_number"""
SQL_ACCOUNT_RISK_STATUS = _decisions_sql(ACCOUNT_RISK_STATUS)

BLOCKED_ACCOUNTS = f"""
, {_TOP.strip()},
flagged AS (SELECT * FROM decided WHERE should_block OR risk_level IN ('high', 'critical')),
reasons AS (SELECT f.account_number, string_agg(DISTINCT top.code, ',' ORDER BY top.code) AS reasons
            FROM flagged f JOIN top USING (transaction_id) GROUP BY f.account_number)
SELECT f.account_number AS account_id, count(*) AS flagged_count, min(f.event_time) AS first_flagged,
       max(f.event_time) AS last_flagged, coalesce(any_value(r.reasons), '') AS reasons
FROM flagged f LEFT JOIN reasons r USING (account_number) GROUP BY f.account_number"""
SQL_BLOCKED_ACCOUNTS = _decisions_sql(BLOCKED_ACCOUNTS)

SQL_ACCOUNT_HOLDERS = _decisions_sql("""
SELECT account_number,
  count(DISTINCT national_code) AS n_national_codes, string_agg(DISTINCT national_code, ',' ORDER BY national_code) AS national_codes,
  count(DISTINCT mobile_normalized) AS n_mobiles, string_agg(DISTINCT mobile_normalized, ',' ORDER BY mobile_normalized) AS mobiles,
  count(DISTINCT card_pan) AS n_cards, string_agg(DISTINCT card_pan, ',' ORDER BY card_pan) AS cards
FROM tx GROUP BY account_number""")

SQL_DECISION_LOOKUP = _decisions_sql("""
SELECT transaction_id, account_number AS account_id, risk_score, risk_level, should_block, alert_count FROM decided""")


def _fix(sql: str) -> str:
    return sql.replace(")\n\n, top AS", "),\ntop AS").replace("\n, top AS", ",\ntop AS")


QUERIES = {
    "monitor_stats": (q_monitor_stats, SQL_MONITOR_STATS),
    "risk_distribution": (q_risk_distribution, SQL_RISK_DISTRIBUTION),
    "transaction_records": (q_transaction_records, SQL_TRANSACTION_RECORDS),
    "recent_transactions": (q_recent_transactions, SQL_RECENT_TRANSACTIONS),
    "alert_feed": (q_alert_feed, _fix(SQL_ALERT_FEED)),
    "risk_timeline": (q_risk_timeline, SQL_RISK_TIMELINE),
    "account_risk_status": (q_account_risk_status, SQL_ACCOUNT_RISK_STATUS),
    "blocked_accounts": (q_blocked_accounts, _fix(SQL_BLOCKED_ACCOUNTS)),
    "account_holders": (q_account_holders, SQL_ACCOUNT_HOLDERS),
    "decision_lookup": (q_decision_lookup, SQL_DECISION_LOOKUP),
}
