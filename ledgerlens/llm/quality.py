"""Quality: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (proximal, per coordinate) updates.

Words are runs of letters and digits and runs of other signs, between white
space; a run of over ``LONGEST`` bytes counts as several words.  Every word has a hash of its
lower-cased bytes and a shape: its hash for signs; upper, lower, mixed or no
case, and digits, for the others; a word that repeats the one before it has a
shape of its own.  Features are the n-grams of 1 and 2 words and of 1 to 3
shapes, hashed to 2^18 places; a place's value is log(1 + count), and a text's
values have length 1.  A score is the logistic of the sparse dot product.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash
of their id, and of rows that repeat an id one, that of the smallest text.
They are dealt to ``SHARDS`` shards by that hash.  In every one of ``EPOCHS``
passes each shard goes on from the common state, row by row in the order of
the hash, and the changes of a place are averaged over the shards that made
any.  The driver holds the state, 2 x 2^18 numbers, and no row.  Scoring reads
every text.

Cases: null and empty texts and texts of white space have no features and get
the intercept's score; unlabelled rows, null ids and null labels are not
learned from; of an id labelled twice the larger label counts; without any
labelled row, or with one class only, every score is the share of label 1 (0
if none); long texts are read in pieces cut between words, n-grams reach
across the cuts (a run of over PIECE bytes without white space is cut there);
an empty table gives an empty table; a column named as the score is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import position_crc
from .common import byte_groups, trim, written

BITS = 18
#: Labelled rows the classifier is fitted on.
MAX_ROWS = 16384
SHARDS, EPOCHS = 4, 4
#: Step size, its offset, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
PIECE, LONGEST = 1 << 20, 64
#: Bytes by kind: 0 white space and controls, 1 letters and digits, 2 signs.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
UPPER_CASE, LOWER_CASE, DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
SAME = np.uint32(0x5A17)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, shape) of the words of some bytes."""
    kind = KIND[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(data) else np.zeros(0, np.int64)
    end = np.concatenate([edge[1:], [len(data)]]) if len(edge) else edge
    own = kind[edge] > 0
    edge, end = edge[own], end[own]
    parts = np.maximum(1, -(-(end - edge) // LONGEST))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(edge, parts) + LONGEST * nth
    end = np.minimum(start + LONGEST, np.repeat(end, parts))
    h = position_crc.of_spans(LOWER[data], start, end)
    if not len(start):
        return start, h, h

    def some(table):
        running = np.concatenate([[0], np.cumsum(table[data])])
        return running[end] > running[start]

    shape = some(UPPER_CASE) + 2 * some(LOWER_CASE) + 4 * some(DIGIT)
    return start, h, np.where(kind[start] == 2, mixed(h, 7), shape.astype(np.uint32))


def cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of at most PIECE bytes that end after white space if there is any."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        if hi < len(data):
            gaps = np.flatnonzero(KIND[data[lo:hi]] == 0)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        yield lo, hi
        lo = hi


def places(h: np.ndarray, shape: np.ndarray, text: np.ndarray, skip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, text) of every n-gram that ends at word ``skip`` or later."""
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    signs = np.where(again, SAME, shape)
    for salt, (items, n) in enumerate(((h, 1), (h, 2), (signs, 1), (signs, 2), (signs, 3))):
        if len(h) < n:
            continue
        gram = np.full(len(h) - n + 1, salt + 1, dtype=np.uint32)
        for i in range(n):
            gram = mixed(gram, salt) + items[i:len(h) - n + 1 + i]
        own = (text[n - 1:] == text[:len(h) - n + 1]) & (np.arange(n - 1, len(h)) >= skip)
        yield (mixed(gram, salt)[own] >> np.uint32(32 - BITS)).astype(np.int64), text[n - 1:][own]


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found))


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of all features of some texts, by text and place."""
    keys, counts, number = [np.zeros(0, np.int64)], [np.zeros(0)], 0
    while number < len(texts):
        group, size = [texts[number]], len(texts[number])
        while size < PIECE and number + len(group) < len(texts):
            group.append(texts[number + len(group)])
            size += len(group[-1])
        data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])
        held = [np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        for lo, hi in cuts(data):
            start, h, shape = words(data[lo:hi])
            text = np.searchsorted(begins, start + lo, side="right") - 1 + number
            skip = len(held[0])
            held = [np.concatenate(p) for p in zip(held, (h, shape, text))]
            part = [(t << BITS) | p for p, t in places(*held, skip)]
            if part:
                found, n = counted(part, [np.ones(len(p)) for p in part])
                keys.append(found)
                counts.append(n)
            if len(keys) > 8:
                merged = counted(keys, counts)
                keys, counts = [merged[0]], [merged[1]]
            held = [a[-3:] for a in held]  # words before, for n-grams across the cut and repeats
        number += len(group)
    key, n = counted(keys, counts)
    text, value = key >> BITS, np.log1p(n)
    square = np.bincount(text, weights=value * value, minlength=len(texts))
    return text, key & ((1 << BITS) - 1), value / np.sqrt(square)[text]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that the state stands for: sparse by the first penalty."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def update(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, label: int) -> None:
    """One row's update of the state at its places (changed in place)."""
    w = weights(z[at], n[at])
    p = 1 / (1 + np.exp(-np.clip(float(w @ value), -35, 35)))
    g = (p - label) * value
    step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
    z[at] += g - step * w
    n[at] += g * g


class Model:
    """One weight for each place, the last that of the intercept."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight

    def scores(self, texts: list[bytes]) -> np.ndarray:
        text, at, value = vectors(texts)
        dot = np.bincount(text, weights=self.weight[at] * value, minlength=len(texts)) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(dot, -500, 500)))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, hash, label, text) to (shard, hash, label, at, value)."""
    for batch in batches:
        lo = 0
        for part in byte_groups(batch.column(3)):
            text, at, value = vectors(part.to_pylist())
            ends = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(a, t)) for a, t in ((at, pa.int32()), (value, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(part)) for i in range(3)), *lists],
                                             names=["shard", "hash", "label", "at", "value"])
            lo += len(part)
    trim()


def trainer(z0: np.ndarray, n0: np.ndarray):
    """Body: the rows of whole shards, in order, to each shard's changes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, z, n = None, z0, n0

        def changes():
            at = np.flatnonzero((z != z0) | (n != n0))
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(z[at] - z0[at]), pa.array(n[at] - n0[at])],
                                              names=["at", "z", "n"])

        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != shard:
                    if shard is not None:
                        yield changes()
                    shard, z, n = own, z0.copy(), n0.copy()
                at = np.append(np.asarray(batch.column(3)[i].values), len(z0) - 1)
                value = np.append(np.asarray(batch.column(4)[i].values), 1.0)
                update(z, n, at, value, batch.column(2)[i].as_py())
        if shard is not None:
            yield changes()
    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Model from the labelled rows of ``docs``; ``labels`` holds the rows that
    may be learned from."""
    own = (labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
           .where("key is not null and label is not null").groupBy("key").agg(F.max("label").alias("label")))
    chosen = own.orderBy(F.xxhash64("key"), "key").limit(max_rows)  # at most max_rows small rows: broadcast
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = joined.select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("key").alias("hash"),
                         (F.col("label") > 0).cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    rows = written(rows.mapInArrow(featured, "shard int, hash bigint, label int, at array<int>, value array<double>"), "quality-features")
    sums = rows.agg(F.sum("label"), F.count("*")).first()
    ones, total = sums[0] or 0, sums[1]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if not ones or ones == total:
        z[-1] = 40.0 if ones else -40.0
        return Model(z)
    dealt = rows.repartitionById(SHARDS, "shard").sortWithinPartitions("shard", "hash")
    for _ in range(EPOCHS):
        changes = dealt.mapInArrow(trainer(z, n), "at int, z double, n double").groupBy("at").agg(
            F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()  # at most a row for each place
        at = np.asarray(changes["at"])
        z[at] += np.asarray(changes["z"])
        n[at] += np.asarray(changes["n"])
    return Model(weights(z, n))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of ``text``."""
    def run(batches):
        for col in batches:
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            parts = [model.scores(part.to_pylist()) for part in byte_groups(col)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        trim()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return df.withColumn(out, F.arrow_udf(run, "double")(whole))
