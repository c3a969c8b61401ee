"""Queries over ``documents``: each applies its operator to the whole table
and derives the digest columns from the operator's output."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, quality, sentencepiece_codec, simhash, suffix_dedup, token_count, token_files, toxicity
from .common import scratch, sha256_of_ints, table, vocabulary, written

PIECES, BYTES, WORDS = "piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 2
LIMIT_TOKENS = 1024
TOXIC_FROM = 0.7
GOOD_FROM = 0.7
SHINGLE_WORDS, MAX_BITS = 3, 3
REPEAT_BYTES = 50


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    model = vocabulary(PIECES)
    ids = sentencepiece_codec.encode(texts(spark, sf_dir), model).select("doc_id", "ids")
    return sentencepiece_codec.decode(ids, model).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256_of_ints(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    counted = token_count.count_tokens(texts(spark, sf_dir), vocabulary(BYTES))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of every text."""
    found = suffix_dedup.dedup(texts(spark, sf_dir), REPEAT_BYTES)
    return found.select(F.col("meta.doc_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string")) % 3 == 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Model learned from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    docs = texts(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    fps = written(simhash.with_fingerprints(texts(spark, sf_dir), SHINGLE_WORDS).select("doc_id", "fp"), "fingerprints")
    return simhash.group(fps, MAX_BITS).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, written and read back."""
    path = scratch(spark, "token-files")
    token_files.write(texts(spark, sf_dir), path, vocabulary(WORDS), END_ID)
    return token_files.read(spark, path, token_files.crc32).withColumnRenamed("digest", "ids_crc32")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every text."""
    found = decontaminate.find(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("key.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards ``benchmark``, and the rank of
    the tenth of them that is drawn."""
    found = importance.resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
words AS (SELECT side, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crc_table),
own AS (SELECT side, row, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM own GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM sides) + 10000))))::BIGINT AS gain FROM sides),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM own JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY row),
scored AS (SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'),
ranks AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features, row) AS rank
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) FROM ranks) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranks USING (row)"""


def quality_held_out(key) -> F.Column:
    return F.crc32(key.cast("string")) % 4 == 2


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labelled rows that are not
    held out."""
    docs = texts(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality_held_out(F.col("doc_id"))))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(quality_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op6_toxicity": (op6_toxicity, None),
    "op8_simhash": (op8_simhash, None),
    "op9_token_files": (op9_token_files, None),
    "op10_decontamination": (op10_decontamination, None),
    "op11_importance": (op11_importance, OP11_SQL),
    "op13_quality": (op13_quality, None),
}
