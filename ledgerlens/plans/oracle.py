"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement rebuilds the transactions from ``events`` ⟕ ``customer`` with
the same deterministic formulas as ``sources.testdata`` and then computes the
query independently in SQL.
"""
from __future__ import annotations

from .. import config


def _national_code_sql(uid: str) -> str:
    body = f"CAST({uid} % 40 + 100000000 AS VARCHAR)"
    s = " + ".join(f"CAST(substr({body}, {i + 1}, 1) AS INTEGER) * {10 - i}" for i in range(9))
    s = f"(({s}) % 11)"
    return f"{body} || CAST(CASE WHEN {s} < 2 THEN {s} ELSE 11 - {s} END AS VARCHAR)"


def tx_cte() -> str:
    """Clean transactions (the columns the queries use)."""
    return f"""
tx AS (
  SELECT
    e.user_id,
    e.event_id,
    'TX-' || lpad(CAST(e.event_id AS VARCHAR), 8, '0') AS transaction_id,
    e.ts AS event_time,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc,
    CAST(round(e.value * 3000000) AS BIGINT) AS amount_rial,
    '603799' || lpad(CAST((e.user_id % 50) * 7919 AS VARCHAR), 10, '0') AS card_pan,
    'ACC-' || lpad(CAST(e.user_id % 30 AS VARCHAR), 3, '0') AS account_number,
    {_national_code_sql('e.user_id')} AS national_code,
    '+98912' || lpad(CAST(e.user_id AS VARCHAR), 7, '0') AS mobile_e164,
    '0912' || lpad(CAST(e.user_id AS VARCHAR), 7, '0') AS mobile_normalized,
    (CASE WHEN e.user_id % 10 = 0 THEN '10.0.0.' ELSE '185.1.1.' END) || CAST(e.user_id % 3 AS VARCHAR) AS ip_address,
    (e.user_id % 10 = 0) AS is_carrier_nat,
    CASE WHEN e.user_id % 10 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS ip_confidence,
    'fp-' || CAST(e.user_id % 5 AS VARCHAR) AS device_fingerprint,
    sha256('fp-' || CAST(e.user_id % 5 AS VARCHAR)) AS device_fp_hash,
    e.event_type AS channel,
    CASE WHEN e.event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS result,
    (hour(e.ts) >= 20 OR hour(e.ts) < 2) AS is_night,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 'commercial' WHEN 'MACHINERY' THEN 'vip' ELSE 'normal' END AS account_type
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
)"""


def limits_cte() -> str:
    rows = ", ".join(f"('{t}', {a}, {b}, {c}, {d})" for t, a, b, c, d in config.LIMITS)
    return (f"limits AS (SELECT * FROM (VALUES {rows}) "
            f"AS l(account_type, single_tx, daily_total, structuring_threshold, structuring_count))")


def bucket_sql(ts: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(epoch_us({ts}) - ((epoch_us({ts}) % {us}) + {us}) % {us})"


def with_tx(body: str, *extra_ctes: str) -> str:
    ctes = [tx_cte()] + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body


END_OF_DATA = "(SELECT date_trunc('day', max(event_time)) + INTERVAL 1 DAY FROM tx)"
