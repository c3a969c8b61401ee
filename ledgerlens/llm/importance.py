"""Target-distribution importance resampling over hashed word n-grams.

Texts are lower-cased in A-Z; words are runs of 0-9, a-z and characters beyond
ASCII.  Features are all runs of 1 to ``longest`` consecutive words of a text,
joined by one space; a feature's bucket is its CRC-32 (position_crc) modulo
``buckets``.  The buckets of the raw and of the target texts are counted over
all rows (one small array a task); a bucket's gain is the floored scaled log
ratio of its smoothed shares, a document's weight the sum of its gains.  A
Gumbel number from a hash of the document's key is added, and the rows with
the highest scores are drawn: a sample without replacement that follows the
target.  Ranks come from one range-partitioned sort and the row counts of its
partitions; no task holds more than its range.

Cases: null and empty texts have no features, weight 0; a null key is the
empty string in the hash and comes last among ties; rows that repeat a key and
text tie and are dealt by their place in the table, so ranks are whole; rows
below ``least_words`` words are scored but neither counted nor drawn; an empty
target or an empty table counts as zero features; long texts are read in
pieces cut between words (n-grams reach across the cuts), long words block by
block; columns of any name are held apart in ``row``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import position_crc
from .common import byte_groups, trim, written

#: Bytes handled together; a longer text is cut between words.
PIECE = 1 << 20
#: Byte values as they count: A-Z lower-cased, 0 for bytes between words.
WORD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)],
                dtype=np.uint8)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes as WORD has them, number of the text of each byte): every text
    ends in a 0 byte; pieces of about PIECE bytes end between words."""
    raw, owner, held = [], [], 0
    for number, text in enumerate(texts):
        data = WORD[np.frombuffer(text + b" ", dtype=np.uint8)]
        lo = 0
        while lo < len(data):
            hi = len(data)
            if hi - lo > PIECE:
                gaps = np.flatnonzero(data[lo:lo + PIECE] == 0)
                if not len(gaps):  # one word longer than a piece: up to its end
                    gaps = np.array([PIECE + int(np.argmax(data[lo + PIECE:] == 0))])
                hi = lo + int(gaps[-1]) + 1
            raw.append(data[lo:hi])
            owner.append(number)
            held += hi - lo
            lo = hi
            if held >= PIECE:
                yield np.concatenate(raw), np.repeat(owner, [len(r) for r in raw])
                raw, owner, held = [], [], 0
    if raw:
        yield np.concatenate(raw), np.repeat(owner, [len(r) for r in raw])


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, buckets of n-grams, number of the text of each), piece by piece."""
    before, before_owner = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    for data, owner in pieces(texts):
        # the last words of the piece before, for n-grams that reach across
        data, owner, skip = np.concatenate([before, data]), np.concatenate([before_owner, owner]), len(before)
        inside = data != 0
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # one separator after each word
        data, owner = data[keep], owner[keep]
        skip = int(keep[:skip].sum())
        gaps = np.flatnonzero(data == 0)
        if len(gaps):
            end, start = gaps, np.concatenate([[0], gaps[:-1] + 1])
            joined = np.where(data == 0, np.uint8(32), data)
            for n in range(1, longest + 1):
                first, last = start[:len(start) - n + 1], end[n - 1:]
                own = (last >= skip) & (owner[first] == owner[last]) if len(first) else np.zeros(0, bool)
                first, last = first[own], last[own]
                yield n, position_crc.of_spans(joined, first, last) % np.uint32(buckets), owner[first]
        if longest > 1 and len(gaps):
            lo = 0 if len(gaps) < longest else int(gaps[-longest]) + 1
            before, before_owner = data[lo:], owner[lo:]


def counts(longest: int, buckets: int):
    """Body: texts to the features of each bucket (bucket, n), once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in byte_groups(batch.column(0)):
                for _, bucket, _ in features(part.to_pylist(), longest, buckets):
                    held += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])
        trim()
    return run


def weigher(gains: np.ndarray, longest: int):
    """Body of an Arrow function: features, words and weight of every text."""
    kind = pa.struct([("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for col in batches:
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            out = []
            for part in byte_groups(col):
                total = np.zeros((3, len(part)), dtype=np.int64)
                for n, bucket, owner in features(part.to_pylist(), longest, len(gains)):
                    each = np.bincount(owner, minlength=len(part))
                    total[0] += each
                    total[1] += each if n == 1 else 0
                    running = np.concatenate([[0], np.cumsum(gains[bucket])])
                    last = np.cumsum(each)
                    total[2] += running[last] - running[last - each]
                out.append(pa.StructArray.from_arrays([pa.array(t) for t in total], fields=list(kind)))
            yield pa.concat_arrays(out) if out else pa.array([], kind)
        trim()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_features bigint, n_words bigint, weight bigint")


def utf8(text: str):
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")


def gains(raw: DataFrame, target: DataFrame, text: str, target_text: str, longest: int, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of every bucket; the
    driver gets at most ``buckets`` rows."""
    def counted(df, column, name):
        return (df.select(utf8(column).alias("text")).mapInArrow(counts(longest, buckets), "bucket int, n bigint")
                .groupBy("bucket").agg(F.sum("n").alias(name)))
    both = counted(raw, text, "s").join(counted(target, target_text, "t"), "bucket", "full").fillna(0).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """The eligible rows of ``scored`` with their rank if drawn."""
    key = F.col("key")
    order = [F.col("score").desc(), key.asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("place")]
    where = F.monotonically_increasing_id()
    inside = written(scored.where("eligible").orderBy(*order).select("*", F.spark_partition_id().alias("part"), where.alias("at")),
                     "importance-order")
    sizes = inside.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # one row a partition
    offsets, before = [], 0
    for r in sorted(sizes):
        offsets.append((r.part, before - r.first))
        before += r.n
    drawn = percent * before // 100
    spark = scored.sparkSession
    moves = F.broadcast(spark.createDataFrame(offsets, "part int, move bigint"))  # one row a partition
    rank = F.col("at") + F.col("move") + 1
    return inside.join(moves, "part").withColumn("rank", F.when(rank <= drawn, rank))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             longest: int = 1, buckets: int = 10000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(row, n_features, weight, score, rank) of every row of ``docs``; rank is
    null for rows that are not drawn; ``row`` holds the columns but the text."""
    table = gains(docs, target, text, target_text, longest, buckets)
    others = F.struct(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in docs.columns if c not in (key, text)])
    rows = docs.select(others.alias("row"), F.col(f"`{key}`").alias("key"), weigher(table, longest)(utf8(text)).alias("w"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(rows.select("row", "key", "w.n_features", "w.weight", (F.col("w.weight") + gumbel).cast("bigint").alias("score"),
                                 (F.col("w.n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("place")),
                     "importance-scores")
    columns = ["row", "n_features", "weight", "score"]
    others = scored.where("not eligible").select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked(scored, percent).select(*columns, F.col("rank").cast("bigint")).unionAll(others)
