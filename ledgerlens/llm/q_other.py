"""Queries over ``conversations``, ``embeddings`` and the placement of
``documents``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, sharding, whitening
from .common import table

#: Schemas of the tools that the derived calls name.
SCHEMAS: dict[str, chat.Schema] = {
    "search": {"query": ("string", True, 1, 200), "limit": ("integer", True, 1, 50), "page": ("integer", False, 0, 300)},
    "note": {"query": ("string", True, 1, 1000), "limit": ("integer", False, 3, None), "page": ("integer", False, 0, None)},
    "answer": {"query": ("string", True, 20, None), "limit": ("integer", True, 1, 400), "page": ("string", False, None, None)},
}
TOOLS = list(SCHEMAS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as tool messages: an assistant's turn is a call whose
    arguments hold its text, which uses the results of the calls a half and a
    third of its number; a user's turn is the result of the call before it."""
    turns = table(spark, sf_dir, "conversations")
    call, user = F.col("role") == "assistant", F.col("role") == "user"
    k, odd = F.floor(F.col("turn") / 2), F.col("turn") % 2

    def name(turn):
        return F.concat(F.lit("call-"), turn.cast("string"))

    def parent(share):
        return name(2 * F.floor(k / share) + odd)

    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(text.alias("query"), F.col("turn").alias("page"),
                                   F.size(F.split(text, " ")).alias("limit")))
    return turns.select(
        "conv_id", "turn", F.when(user, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(call, name(F.col("turn"))).alias("call_id"),
        F.when(call, F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("turn") % len(TOOLS) + 1).cast("int"))).alias("tool"),
        F.when(call, arguments).alias("arguments"),
        F.when(call & (k > 0), F.array(parent(2), parent(3))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(user, name(F.col("turn") - 1)).alias("result_id"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of all conversations, linked, ordered and checked."""
    return chat.link(messages(spark, sf_dir), SCHEMAS).select(
        "conv_id", "turn", "call_id", "tool", "topo_level", F.array_join("errors", "; ").alias("errors"), "result_turn",
        "call_json")


OP4_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, turn // 2 AS k, turn % 2 AS odd FROM conversations),
raw AS (SELECT conv_id, turn, k, odd, coalesce(text, '') AS q, len(string_split(coalesce(text, ''), ' ')) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS r FROM t WHERE role = 'assistant') WHERE r = 1),
edges AS (SELECT DISTINCT c.conv_id, c.turn, p.turn AS parent FROM raw c JOIN raw p
  ON p.conv_id = c.conv_id AND p.turn IN (2 * (c.k // 2) + c.odd, 2 * (c.k // 3) + c.odd) WHERE c.k > 0),
paths AS (SELECT conv_id, turn, 0 AS level FROM raw
  UNION SELECT e.conv_id, e.turn, p.level + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.parent = p.turn),
levels AS (SELECT conv_id, turn, max(level) AS topo_level FROM paths GROUP BY ALL),
results AS (SELECT conv_id, turn AS result_turn, min(text) AS result FROM t WHERE role = 'user' GROUP BY ALL)
SELECT c.conv_id, c.turn, 'call-' || c.turn AS call_id, ['search', 'note', 'answer'][c.turn % 3 + 1] AS tool,
  l.topo_level::INTEGER AS topo_level,
  array_to_string(list_sort(list_filter(CASE c.turn % 3
    WHEN 0 THEN [CASE WHEN len(q) < 1 THEN 'query: below 1' WHEN len(q) > 200 THEN 'query: above 200' END,
                 CASE WHEN n < 1 THEN 'limit: below 1' WHEN n > 50 THEN 'limit: above 50' END,
                 CASE WHEN c.turn > 300 THEN 'page: above 300' END]
    WHEN 1 THEN [CASE WHEN len(q) < 1 THEN 'query: below 1' WHEN len(q) > 1000 THEN 'query: above 1000' END,
                 CASE WHEN n < 3 THEN 'limit: below 3' END]
    ELSE [CASE WHEN len(q) < 20 THEN 'query: below 20' END,
          CASE WHEN n < 1 THEN 'limit: below 1' WHEN n > 400 THEN 'limit: above 400' END, 'page: not string']
    END, lambda x: x IS NOT NULL)), '; ') AS errors,
  r.result_turn,
  '{"arguments":{"limit":' || n || ',"page":' || c.turn || ',"query":' || to_json(q) || '},"id":"call-' || c.turn
  || '","name":"' || ['search', 'note', 'answer'][c.turn % 3 + 1] || '","result":' || coalesce(to_json(r.result), 'null') || '}'
  AS call_json
FROM raw c JOIN levels l USING (conv_id, turn) LEFT JOIN results r ON r.conv_id = c.conv_id AND r.result_turn = c.turn + 1"""


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sharding.place(docs)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the first components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    "op4_chat_formatting": (op4_chat_formatting, OP4_SQL),
    "op5_nearest_neighbours": (op5_nearest_neighbours, None),
    "op7_sharding": (op7_sharding, sharding.place_sql("documents", "doc_id", "doc_id, strlen(text)::BIGINT AS n_bytes")),
    "op12_whitening": (op12_whitening, None),
}
