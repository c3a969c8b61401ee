"""Embedding whitening: principal components by FEAST contour integration.

A vector's entries c become the integers x = floor(256 * c).  The fit list
holds each distinct x vector once.  Its covariance V (divisor n, centred before
multiplying) is summed from one partial matrix a task.  The leading unit
eigenvectors come from FEAST: an interval that holds the wanted eigenvalues is
found by inertia counts (negative pivots of a shifted symmetric factorisation),
complex shifted solves at Gauss-Legendre nodes of a circle around the interval
filter a subspace, Rayleigh-Ritz extracts the components, and the inertia count
of the interval has to equal the number found, else the subspace grows.

Vectors of every length are a collection of their own, with one covariance of
length x length numbers; nothing that grows with the rows is in one task, and
the driver sees no row.

Cases: vectors that are null or hold null or non-finite entries are dropped,
ids may be null or repeat (every row gets its result); repeated vectors count
once in the fit; a direction of no variance (one vector only, constant
entries, fewer vectors than entries) is no component, so vectors may have
fewer rows than wanted components, an empty vector or a collection of one
vector has none; eigenvalues that tie are numbered as the solver returns them;
a deviation beyond a long is null; an empty table gives an empty table;
columns of any name are held apart in ``row``.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256.0
COMPONENTS = 4
#: Quadrature nodes on the upper half of the circle, refinement rounds.
NODES, ROUNDS = 12, 40
#: Residual, relative to the matrix, at which a component is done, and the
#: share of the trace at or below which a direction has no variance.
TOLERANCE, NO_VARIANCE = 4e-15, 1e-13
#: Numbers that a task holds in partial matrices before it sends them.
HELD = 1 << 22
#: Numbers of all lengths' centres and components together up to which they
#: are broadcast; beyond, rows and they meet on (length, one of SALTS).
SENT, SALTS = 1 << 21, 64


def integer_vectors(df: DataFrame, vector: str) -> DataFrame:
    """(row, size, x) of the rows whose vector has finite entries only."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(F.coalesce(finite, F.lit(False))).select(
        others.alias("row"), F.size(v).alias("size"), F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, x) to the exact sums of a task (size, n, total)."""
    held: dict[int, list] = {}
    for batch in batches:
        size = np.asarray(batch.column(0))
        for d in np.unique(size).tolist():
            x = np.asarray(batch.column(1).filter(pa.array(size == d)).flatten()).reshape(-1, d)
            own = held.setdefault(d, [0, np.zeros(d, dtype=object)])
            own[0] += len(x)
            own[1] += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    for d, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["size", "i", "n", "total"])


def centres(fit: DataFrame) -> DataFrame:
    """One row a size: n, and the sums S as q = S div n and r = S mod n."""
    each = (fit.mapInArrow(sums, "size int, i int, n bigint, total decimal(38,0)").groupBy("size", "i")
            .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")))
    n = F.col("n").cast("decimal(20,0)")
    rest = F.pmod(F.col("total"), n)
    each = each.select("size", "i", "n", ((F.col("total") - rest) / n).cast("bigint").alias("q"), rest.cast("bigint").alias("r"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "q", "r")))
    return (each.groupBy("size").agg(F.first("n").alias("n"), ordered.alias("at"))
            .select("size", "n", F.col("at.q").alias("q"), F.col("at.r").alias("r")))


def centred(x, q, r, n):
    """x - S / n as doubles: the integer part is taken off exactly."""
    return F.zip_with(F.zip_with(x, q, lambda a, b: a - b), r, lambda a, b: a.cast("double") - b / n)


def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, y) to a task's sums of products (size, i, j, total), i <= j."""
    held: dict[int, np.ndarray] = {}

    def sent():
        for d, m in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(m[i, j])], names=["size", "i", "j", "total"])
        held.clear()

    for batch in batches:
        size = np.asarray(batch.column(0))
        for d in np.unique(size).tolist():
            y = np.asarray(batch.column(1).filter(pa.array(size == d)).flatten()).reshape(-1, d)
            if d not in held:
                if held and sum(m.size for m in held.values()) + d * d > HELD:
                    yield from sent()
                held[d] = np.zeros((d, d))
            held[d] += y.T @ y
    yield from sent()


def inertia(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: the signs of the
    pivots of a factorisation with 1 x 1 and 2 x 2 pivots."""
    a, found, size = a.copy(), 0, len(a)
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    k = 0
    while k < size:
        below = np.abs(a[k + 1:, k])
        top = below.max() if len(below) else 0.0
        if max(abs(a[k, k]), top) == 0:
            k += 1
            continue
        width = 1
        if abs(a[k, k]) < alpha * top:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * top * top:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    width = 2
        pivot, c = a[k:k + width, k:k + width], a[k + width:, k:k + width]
        found += int((np.linalg.eigvalsh(pivot) < 0).sum()) if width == 2 else int(pivot[0, 0] < 0)
        a[k + width:, k + width:] -= c @ np.linalg.solve(pivot, c.T)
        k += width
    return found


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of v greater than the shift."""
    return inertia(shift * np.eye(len(v)) - v)


def interval(v: np.ndarray, wanted: int, floor: float) -> tuple[float, float, int]:
    """Bounds around the largest ``wanted`` eigenvalues above ``floor`` (all, if
    fewer; more where they lie close) and how many lie between."""
    high = float(np.abs(v).sum(1).max()) * (1 + 1e-12)
    total = above(v, floor)
    if total <= wanted:
        return floor, high, total
    low, top, count = floor, high, total  # above(low) >= wanted > above(top)
    while count > wanted + 4 and top - low > 1e-14 * high:
        middle = (low + top) / 2
        own = above(v, middle)
        if own >= wanted:
            low, count = middle, own
        else:
            top = middle
    return low, high, count


def feast(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance (falling) and their unit
    vectors (rows): at most ``wanted``, none without variance."""
    d, trace = len(v), float(np.trace(v))
    if not d or not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    scaled = v / trace
    low, high, count = interval(scaled, wanted, NO_VARIANCE)
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    angles = (angles + 1) * np.pi / 2
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, 2 * count + 8)
    while True:
        rng = np.random.default_rng(d)
        basis = np.linalg.qr(rng.standard_normal((d, width)))[0]
        for _ in range(ROUNDS):
            moved = np.zeros((d, width))
            for angle, weight in zip(angles, weights):
                turn = radius * np.exp(1j * angle)
                moved += weight / 2 * (turn * np.linalg.solve((middle + turn) * np.eye(d) - scaled, basis.astype(complex))).real
            basis = np.linalg.qr(moved)[0] if width < d else np.eye(d)
            values, turned = np.linalg.eigh(basis.T @ scaled @ basis)
            basis = basis @ turned
            inside = np.flatnonzero((values > low) & (values <= high))[::-1]
            off = np.abs(scaled @ basis[:, inside] - basis[:, inside] * values[inside]).max(initial=0)
            if width == d or (len(inside) == count and off <= TOLERANCE * high):
                break
        if width == d or len(inside) == count:
            break
        width = min(d, 2 * width)  # the count shows components that were missed
    best = basis[:, inside[:wanted]].T
    best = best / np.linalg.norm(best, axis=1, keepdims=True)
    values = np.einsum("ki,ij,kj->k", best, v, best)
    order = np.argsort(-values, kind="stable")
    return values[order], best[order]


def by_size(rows: DataFrame, each: DataFrame, numbers: int) -> DataFrame:
    """Rows with what ``each`` holds for their size; most rows may have one."""
    if numbers <= SENT:
        return rows.join(F.broadcast(each), "size")
    spread = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(spread, ["size", "salt"]).drop("salt")


def components(fit: DataFrame, centre: DataFrame, wanted: int, numbers: int) -> DataFrame:
    """One row a size: values, vectors (component by component) and trace."""
    y = by_size(fit, centre, numbers).select("size", centred("x", "q", "r", F.col("n")).alias("y"))
    products = y.mapInArrow(scatter, "size int, i int, j int, total double").groupBy("size", "i", "j").agg(F.sum("total").alias("total"))

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        d, n = int(part["size"].iloc[0]), int(part["n"].iloc[0])
        v = np.zeros((d, d))
        v[part.i, part.j] = part.total / n
        v[part.j, part.i] = v[part.i, part.j]
        values, vectors = feast(v, wanted)
        return pd.DataFrame({"size": [d], "values": [values.tolist()], "vectors": [vectors.tolist()], "trace": [float(np.trace(v))]})

    return products.join(centre.select("size", "n"), "size").groupBy("size").applyInPandas(
        solved, "size int, values array<double>, vectors array<array<double>>, trace double")


def whiten(df: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error): the
    whitened coordinates of every row on up to ``wanted`` components; ``row``
    holds the columns of ``df``."""
    rows = integer_vectors(df, vector)
    fit = written(rows.where("size > 0").select("size", "x").distinct(), "whitening-fit")
    centre = written(centres(fit), "whitening-centres")
    numbers = (wanted + 3) * (centre.agg(F.sum("size")).first()[0] or 0)
    model = written(components(fit, centre, wanted, numbers).join(centre, "size"), "whitening-components")

    def projected(k):
        """Coordinates on the first components, one for each."""
        def along(u, value):
            dot = F.aggregate(F.zip_with("y", u, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
            return dot / F.sqrt(value)
        return F.zip_with("vectors", "values", along).alias(k)

    def placed(source, each):
        return by_size(source, each, numbers).withColumn("y", centred("x", "q", "r", F.col("n"))).withColumn("w", projected("w"))

    pairs = [(i, j) for i in range(wanted) for j in range(i, wanted)]
    w = F.col("w")
    spread = placed(fit, model).groupBy("size").agg(*[F.covar_pop(F.get(w, F.lit(i)), F.get(w, F.lit(j))).alias(f"c{i}_{j}")
                                               for i, j in pairs])
    off = F.greatest(*[F.abs(F.col(f"c{i}_{j}") - (1.0 if i == j else 0.0)) for i, j in pairs], F.lit(0.0))
    whole = written(spread.select("size", off.alias("identity_error")).join(model, "size"), "whitening-model")
    zero = F.lit(0).cast("bigint")
    n_off = F.zip_with(F.zip_with("x", "q", F.try_subtract), "r", lambda a, b: F.try_subtract(F.try_multiply("n", a), b))
    deviation = F.aggregate(n_off, zero, lambda s, a: F.try_add(s, F.try_multiply(a, a)))
    share = F.transform("values", lambda e: e / F.col("trace"))
    return (placed(rows, whole)
            .select("row", "n", deviation.alias("deviation"), "identity_error", F.posexplode(F.arrays_zip(w.alias("w"), share.alias("share"))))
            .select("row", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", F.col("col.w").alias("whitened"),
                    F.col("col.share").alias("explained"), "identity_error"))
