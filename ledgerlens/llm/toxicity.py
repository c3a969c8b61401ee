"""Toxicity: linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

Features are the n-grams of 3 to 7 bytes of the lower-cased text with marks as
spaces, hashed to 2^24 places, present or not.  On labelled rows a place's ratio is the log of
its smoothed share among toxic rows over that among the others.  The places
with the largest chi-square statistic stay; a logistic regression is fitted
on their ratios.  A score is the logistic of the weighted sum over the places
present in the whole text.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash
of their id, and of rows that repeat an id one, that of the smallest text;
scoring reads every text, with a table of a bounded number of weights in the
tasks.

Cases: null and empty texts get the intercept's score; unlabelled rows and
null labels are not learned from; of an id labelled twice the larger label
counts; without any labelled row, or with one class only, every score is the
share of toxic rows (0 if none); an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, trim

SIZES = (3, 4, 5, 6, 7)
#: Bytes as the n-grams see them: A-Z lower-cased, other ASCII but a-z and
#: 0-9 a space.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
BITS = 24
#: Labelled rows the classifier is fitted on, and places it keeps.
MAX_ROWS, MAX_PLACES = 8192, 1024
#: Penalty on squared coefficients.
RIDGE = 1.0
#: Places of rows that a task holds before it counts and sends them.
HELD = 1 << 21
#: Bytes of a text whose n-grams are hashed at once.
SPAN = 1 << 18


def places(text: str) -> Iterator[np.ndarray]:
    """Hashed places of all n-grams, span by span (spans overlap)."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(PLAIN) + b" ", dtype=np.uint8)
    for lo in range(0, max(1, len(raw) - max(SIZES) + 1), SPAN):
        part = raw[lo:lo + SPAN + max(SIZES) - 1].astype(np.uint32)
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(part) < n:
                return
            h = h[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            if n in SIZES:
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to rows with any of a place (place, pos, neg); a
    place may come several times."""
    held: list[np.ndarray] = []
    size = 0

    def sent():
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for i in range(0, len(key), 1 << 16):
            own, count = key[i:i + (1 << 16)], n[i:i + (1 << 16)].astype(np.int32)
            pos = np.where(own & 1 == 1, count, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((own >> 1).astype(np.int32)), pa.array(pos), pa.array(count - pos)],
                                             names=["place", "pos", "neg"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            found = list(places(text.as_py()))
            if found:
                held.append(np.unique(np.concatenate(found)).astype(np.uint32) << np.uint32(1) | np.uint32(toxic))
                size += len(held[-1])
            if size > HELD:
                yield from sent()
                size = 0
    if held:
        yield from sent()
    trim()


class Model:
    """Weights (ratio times coefficient) of the kept places, and an intercept."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, intercept: float):
        self.kept, self.weights, self.intercept = kept, weights, intercept
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"kept": self.kept, "weights": self.weights, "intercept": self.intercept, "_table": None}

    def present(self, text: str) -> np.ndarray:
        """Numbers of the kept places that occur in the text, ascending."""
        if self._table is None:
            self._table = np.zeros(1 << BITS, dtype=bool)
            self._table[self.kept] = True
        hits = [found[self._table[found]] for found in places(text)]
        return np.searchsorted(self.kept, np.unique(np.concatenate(hits))) if hits else np.zeros(0, np.int64)

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, ridge: float = RIDGE,
             rounds: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the intercept: Newton steps on
    the log loss with a ridge on the coefficients.  Every step solves a system
    as wide as the kept places."""
    n, width = len(rows), len(ratio) + 1
    x = np.zeros((n, width), dtype=np.float32)
    x[:, -1] = 1
    for i, at in enumerate(rows):
        x[i, at] = ratio[at]
    w = np.zeros(width)
    w[-1] = np.log(labels.mean() / (1 - labels.mean()))
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        slope = (x.T @ (p - labels).astype(np.float32)).astype(np.float64) + penalty * w
        curve = (x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])).astype(np.float64)
        step = np.linalg.solve(curve + np.diag(penalty), slope)
        w = w - step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES,
        key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from the labelled rows of ``docs``; ``labels`` holds the rows that
    may be learned from."""
    own = (labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("toxic"))
           .where("key is not null and toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic")))
    chosen = own.orderBy(F.xxhash64("key"), "key").limit(max_rows)  # at most max_rows small rows: broadcast
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = joined.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = rows.mapInArrow(counted, "place int, pos int, neg int").groupBy("place").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_pos, n = sums[0] or 0, sums[1]
    n_neg = n - n_pos
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if n_pos else -40.0)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    chi = (F.pow(pos * (n_neg - neg) - neg * (n_pos - pos), F.lit(2)) * n
           / ((pos + neg) * (n - pos - neg + F.lit(1e-9)) * n_pos * n_neg))
    best = counts.select("place", F.log(((pos + 1) / (n_pos + 2)) / ((neg + 1) / (n_neg + 2))).alias("ratio"),
                         chi.alias("chi")).orderBy(F.desc("chi"), "place").limit(max_places).collect()
    best = sorted((r.place, r.ratio) for r in best)
    kept, ratio = np.array([p for p, _ in best], dtype=np.int64), np.array([r for _, r in best])
    bare = Model(kept, np.zeros(len(kept)), 0.0)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bare.present(t.as_py()).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["at", "toxic"])

    got = rows.mapInArrow(design, "at array<int>, toxic int").collect()
    got = sorted((r.toxic, r.at) for r in got)
    coefficients, intercept = logistic([np.array(a, dtype=np.int64) for _, a in got],
                                       np.array([t for t, _ in got], dtype=np.float64), ratio)
    return Model(kept, coefficients * ratio, intercept)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of ``text``; a column named ``out`` is replaced."""
    body = over_texts(lambda: lambda texts: pa.array([model.score(t) for t in texts], pa.float64()))

    def run(batches):
        yield from body(batches)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "double")(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
