"""Registered queries: identity graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import graph as G
from ..sources import testdata as TD
from . import oracle as O

MERGE_SPLIT = "2024-01-16 00:00:00"   # first half / second half of the month
CLEANUP_DAYS = 2


def _entities_text(col):
    return F.array_join(F.transform(col, lambda e: F.concat_ws(
        ":", e["type"], e["id"], F.format_number(e["confidence"], 1), e["tx_count"].cast("string"))), ",")


def q_graph_nodes(spark, sf):
    return G.graph_nodes(TD.transactions(spark, sf))


def q_graph_edges(spark, sf):
    e = G.graph_edges(TD.transactions(spark, sf))
    return e.drop("last_event_time")


def q_graph_merge(spark, sf):
    tx = TD.transactions(spark, sf)
    first = tx.filter(F.col("event_time") < F.lit(MERGE_SPLIT).cast("timestamp"))
    second = tx.filter(F.col("event_time") >= F.lit(MERGE_SPLIT).cast("timestamp"))
    nodes, edges = G.ingest_batch(None, None, first, person_key="national_code")
    nodes, edges = G.ingest_batch(nodes, edges, second, person_key="national_code")
    return edges.drop("last_event_time")


def q_graph_cleanup(spark, sf):
    tx = TD.transactions(spark, sf)
    nodes, edges = G.ingest_batch(None, None, tx)
    kept_nodes, kept_edges, deleted = G.cleanup_old_nodes(nodes, edges, TD.end_of_data(tx), CLEANUP_DAYS)
    kept = kept_nodes.groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    return (kept.join(deleted, "label", "full_outer")
                .select("label", F.coalesce("kept", F.lit(0)).alias("kept"),
                        F.coalesce("deleted", F.lit(0)).alias("deleted")))


def q_identity_subgraph(spark, sf):
    tx = TD.transactions(spark, sf)
    nodes, edges = G.ingest_batch(None, None, tx)
    sg = G.identity_subgraph(nodes, edges)
    return sg.select("person_id", F.size("entities").cast("long").alias("n_entities"),
                     _entities_text(F.col("entities")).alias("entities"))


def q_shared_entities(spark, sf):
    tx = TD.transactions(spark, sf)
    edges = G.graph_edges(tx)
    return G.shared_entities(edges)


def q_high_risk_ips(spark, sf):
    return G.high_risk_ips(G.graph_edges(TD.transactions(spark, sf)))


def _edge_events_sql(person: str) -> str:
    parts = []
    for rel, label, col in config.RELATIONS:
        conf = "ip_confidence" if rel == "USES_IP" else "1.0::DOUBLE"
        parts.append(f"SELECT '{rel}' AS rel_type, 'Person' AS from_label, {person} AS from_id, "
                     f"'{label}' AS to_label, {col} AS to_id, {conf} AS confidence, amount_rial AS amount, "
                     f"event_time, timestamp_utc, transaction_id FROM tx")
    return "ev AS (" + " UNION ALL ".join(parts) + ")"


_AGG_EDGES = """
SELECT rel_type, from_label, from_id, to_label, to_id,
  (list(timestamp_utc ORDER BY event_time, transaction_id))[1] AS timestamp_start,
  '9999-12-31T23:59:59Z' AS timestamp_end,
  (list(confidence ORDER BY event_time DESC, transaction_id DESC))[1] AS confidence,
  CAST(sum(amount) AS BIGINT) AS total_amount,
  count(*) AS tx_count,
  (list(timestamp_utc ORDER BY event_time DESC, transaction_id DESC))[1] AS last_timestamp
FROM ev GROUP BY rel_type, from_label, from_id, to_label, to_id"""

_PERSON_TX = "transaction_id || '_person'"

SQL_GRAPH_EDGES = O.with_tx(_AGG_EDGES, _edge_events_sql(_PERSON_TX))
SQL_GRAPH_MERGE = O.with_tx(_AGG_EDGES, _edge_events_sql("national_code"))


def _nodes_sql(person: str) -> str:
    return O.with_tx(
        f"SELECT DISTINCT label, id FROM (SELECT 'Person' AS label, {person} AS id FROM tx UNION ALL "
        + " UNION ALL ".join(f"SELECT '{label}' AS label, {col} AS id FROM tx" for _, label, col in config.RELATIONS)
        + ") WHERE id IS NOT NULL")


SQL_GRAPH_NODES = _nodes_sql(_PERSON_TX)
SQL_GRAPH_NODES_BY_CODE = _nodes_sql("national_code")

SQL_GRAPH_CLEANUP = O.with_tx(f"""
, nodes AS (SELECT DISTINCT label, id FROM (
    SELECT 'Person' AS label, {_PERSON_TX} AS id FROM tx UNION ALL
    {" UNION ALL ".join(f"SELECT '{label}' AS label, {col} AS id FROM tx" for _, label, col in config.RELATIONS)})),
last_use AS (SELECT to_label AS label, to_id AS id, max(event_time) AS last_time FROM ev
             WHERE rel_type IN ('USES_IP', 'USES_DEVICE') GROUP BY ALL),
doomed AS (SELECT n.label, n.id FROM nodes n LEFT JOIN last_use u ON n.label = u.label AND n.id = u.id
           WHERE n.label IN ('IP', 'Device')
             AND (u.last_time IS NULL OR u.last_time <= {O.END_OF_DATA} - INTERVAL {CLEANUP_DAYS} DAYS)),
kept AS (SELECT label, count(*) AS kept FROM nodes WHERE (label, id) NOT IN (SELECT (label, id) FROM doomed)
         GROUP BY label),
del AS (SELECT label, count(*) AS deleted FROM doomed GROUP BY label)
SELECT coalesce(kept.label, del.label) AS label, coalesce(kept, 0) AS kept, coalesce(deleted, 0) AS deleted
FROM kept FULL OUTER JOIN del ON kept.label = del.label""".replace("\n, nodes AS", ",\nnodes AS", 1),
    _edge_events_sql(_PERSON_TX))

SQL_IDENTITY_SUBGRAPH = O.with_tx(f"""
, e AS ({_AGG_EDGES}),
p AS (SELECT {_PERSON_TX} AS person_id FROM tx)
SELECT p.person_id, count(e.to_id) AS n_entities,
  coalesce(string_agg(e.to_label || ':' || e.to_id || ':' || printf('%.1f', e.confidence) || ':' || CAST(e.tx_count AS VARCHAR), ','
             ORDER BY e.to_label, e.to_id), '') AS entities
FROM p LEFT JOIN e ON e.from_id = p.person_id AND e.to_label IN ({", ".join(f"'{x}'" for x in config.ENTITY_LABELS)})
GROUP BY p.person_id""".replace("\n, e AS", ",\ne AS", 1), _edge_events_sql(_PERSON_TX))

SQL_SHARED_ENTITIES = O.with_tx(f"""
, e AS (SELECT from_id AS person_id, to_label, to_id, confidence FROM ({_AGG_EDGES})
        WHERE confidence >= {config.SHARED_MIN_CONFIDENCE}),
pairs AS (SELECT a.person_id, b.person_id AS related_person, a.to_label AS entity_type, a.to_id AS entity_id,
                 a.confidence AS conf1, b.confidence AS conf2
          FROM e a JOIN e b ON a.to_label = b.to_label AND a.to_id = b.to_id AND a.person_id <> b.person_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY conf1 DESC, conf2 DESC,
                  related_person, entity_type, entity_id) AS INTEGER) AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= {config.SHARED_LIMIT}""".replace("\n, e AS", ",\ne AS", 1),
    _edge_events_sql(_PERSON_TX))

SQL_HIGH_RISK_IPS = O.with_tx(f"""
, ip AS (SELECT from_id AS p, to_id AS ip_address FROM ev WHERE rel_type = 'USES_IP'),
card AS (SELECT from_id AS p, to_id AS card FROM ev WHERE rel_type = 'OWNS_CARD')
SELECT ip_address, count(DISTINCT card) AS unique_cards, count(DISTINCT ip.p) AS unique_persons
FROM ip JOIN card USING (p) GROUP BY ip_address HAVING count(DISTINCT card) >= {config.HIGH_RISK_MIN_CARDS}
ORDER BY unique_cards DESC, ip_address LIMIT {config.HIGH_RISK_LIMIT}""".replace("\n, ip AS", ",\nip AS", 1),
    _edge_events_sql(_PERSON_TX))


QUERIES = {
    "graph_nodes": (q_graph_nodes, SQL_GRAPH_NODES),
    "graph_edges": (q_graph_edges, SQL_GRAPH_EDGES),
    "graph_merge": (q_graph_merge, SQL_GRAPH_MERGE),
    "graph_cleanup": (q_graph_cleanup, SQL_GRAPH_CLEANUP),
    "identity_subgraph": (q_identity_subgraph, SQL_IDENTITY_SUBGRAPH),
    "shared_entities": (q_shared_entities, SQL_SHARED_ENTITIES),
    "high_risk_ips": (q_high_risk_ips, SQL_HIGH_RISK_IPS),
}
