"""Corpus pipeline: toxicity filter, near-duplicate and repeated-passage
removal, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of ``documents``.  Null ids
and texts, empty tables, repeated rows and further columns pass through as the
operators define it; further columns are carried along.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, q_text, sentencepiece_codec, simhash, suffix_dedup, toxicity
from ledgerlens.llm.common import sha256_of_ints, table, vocabulary, written

#: SQL cannot express the fitted classifier or the encoder; the tests compare
#: the stages with brute force.
ORACLE_SQL = None


def nested(docs: DataFrame) -> DataFrame:
    """(row, id, text): the columns held apart, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("bigint").alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go; the others stay as they are."""
    model = q_text.toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score(nested(docs).select("row", "text"), model)
    return scored.where(F.col("score") < q_text.TOXIC_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document of the smallest id stays (null
    ids last, then by hash of the text); a row that repeats it goes."""
    named = nested(docs).select("row", "id", "text", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"),
                                F.xxhash64("id", "text").alias("hash"))
    fps = written(simhash.with_fingerprints(named.select("id", "name", "hash", "text"), q_text.SHINGLE_WORDS)
                  .drop("text"), "fingerprints")
    grouped = simhash.group(fps, q_text.MAX_BITS, key="id")
    first = F.min(F.struct(F.col("id").isNull(), "id", "name", "hash")).alias("first")
    stay = grouped.groupBy("root").agg(first).select("first.name", "first.hash")
    return (named.select("row", "name", "hash").join(stay, ["name", "hash"], "left_semi")
            .dropDuplicates(["name", "hash"]).select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters covered by 50-byte strings that also start in a document
    with a smaller id go; n_chars is counted anew.  No document goes."""
    found = suffix_dedup.dedup(docs, q_text.REPEAT_BYTES, whole_characters=True)
    text = F.col("kept").cast("string")
    columns = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return found.select(*[columns[c].alias(c) if c in columns else F.col(f"meta.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = nested(docs).select("row", "text")
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("key.row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and digests of them and of the decoded text."""
    model = vocabulary(q_text.PIECES)
    ids = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), model).drop("text")
    return sentencepiece_codec.decode(ids, model).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        sha256_of_ints(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
