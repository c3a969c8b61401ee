"""Fits over many rows of vectors: Spark's models, other passes.

Spark's network trainer caches all vectors (8 bytes a value) and, beyond the
memory, reads them from disk in every
evaluation; its covariance adds rank-one updates row by row.  Here tasks take
vectors as matrices of some hundred rows:

* ``moments``: count, sums and sums of products about one row, in one pass;
* ``network_weights``: the weights of ``MultilayerPerceptronClassifier``
  (sigmoid layers, softmax, cross entropy, the same first weights, L-BFGS).
  Vectors are written once as compressed matrices; an evaluation reads
  them, and one gradient a task comes to the driver.

Both give Spark's results but for rounding and one thing: the loss here is the
mean over all rows, where Spark's is the mean over stacks of 64, so that rows of
a partition's last, shorter stack count more there.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows in one matrix (its layers fit a core's cache), and tasks (each gives the driver one gradient) at most.
ROWS, TASKS = 512, 1024


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array<double> column that all have ``dim`` values."""
    values = vectors.flatten()
    if vectors.null_count or values.null_count or len(values) != len(vectors) * dim:
        raise ValueError(f"every row needs {dim} values")
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(df: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum over all tasks of the ``size`` numbers that a task finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of_batches(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["found"])

    out = np.zeros(size)
    for row in df.mapInArrow(run, "found binary").collect():  # TASKS rows at most, in order of the tasks
        out += np.frombuffer(row.found)
    return out


# ---------------------------------------------------------------- moments

def moments(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance of the sample) of an array<double> column."""
    first = df.select(vector).first()
    if first is None:
        raise ValueError("no rows to fit")
    about = np.array(first[0], dtype=float)

    def of_batches(batches):
        n, sums, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(lo, ROWS), dim) - about
                n, sums, products = n + len(x), sums + x.sum(0), products + x.T @ x
        return np.concatenate([[n], sums, products.ravel()]) if n else None

    found = totals(df.select(vector).coalesce(TASKS), of_batches, 1 + dim + dim * dim)
    n, sums, products = int(found[0]), found[1:dim + 1], found[dim + 1:].reshape(dim, dim)
    cov = (products - np.outer(sums, sums) / n) / max(n - 1, 1)
    return n, about + sums / n, cov


# ---------------------------------------------------------------- network

def packed(df: DataFrame, vector: str, label: Column, dim: int, classes: int) -> DataFrame:
    """Written matrices (``n`` rows, compressed) with their labels."""
    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x, y = matrix(part.column(0), dim), part.column(1).to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
                    raise ValueError(f"vectors must be finite and labels one of 0 to {classes - 1}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True)], pa.binary()),
                     pa.array([y.astype(np.uint8).tobytes()], pa.binary())], names=["n", "x", "y"])

    return written(df.select(vector, label).mapInArrow(run, "n int, x binary, y binary"), "matrices").coalesce(TASKS)


def layers_of(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, offsets) of each layer: views of Spark's flat weights."""
    out, at = [], 0
    for m, n in zip(layers, layers[1:]):
        out.append((weights[at:at + m * n].reshape(m, n), weights[at + m * n:at + m * n + n]))
        at += m * n + n
    return out


def loss_and_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, gradient: np.ndarray) -> float:
    """Cross entropy summed over the rows; its gradient is added to ``gradient``."""
    net, grads, acts = layers_of(weights, layers), layers_of(gradient, layers), [x]
    for w, b in net[:-1]:
        h = acts[-1] @ w
        h += b
        np.negative(h, out=h)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
            np.exp(h, out=h)
        h += 1
        acts.append(np.reciprocal(h, out=h))
    z = acts[-1] @ net[-1][0] + net[-1][1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[rows, y]).sum())
    delta = p / total
    delta[rows, y] -= 1
    for i in range(len(net) - 1, -1, -1):
        gw, gb = grads[i]
        gw += acts[i].T @ delta
        gb += delta.sum(axis=0)
        if i:
            h = acts[i]
            delta = delta @ net[i][0].T
            delta *= h
            delta *= 1 - h
    return loss


def network_weights(df: DataFrame, vector: str, label: Column, layers: list[int], first: np.ndarray, max_iter: int,
                    tolerance: float) -> np.ndarray:
    """Weights of least mean cross entropy that L-BFGS finds from ``first``."""
    blocks = packed(df, vector, label, layers[0], layers[-1])
    dim = layers[0]

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def of_batches(batches):
            codec, gradient, loss, n = pa.Codec("zstd"), np.zeros(len(weights)), 0.0, 0
            for batch in batches:
                for rows, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(codec.decompress(x, rows * dim * 8, asbytes=True)).reshape(rows, dim)
                    loss += loss_and_gradient(weights, layers, x, np.frombuffer(y, np.uint8), gradient)
                    n += rows
            return np.concatenate([[n, loss], gradient]) if n else None

        found = totals(blocks, of_batches, 2 + len(weights))
        if not found[0]:
            raise ValueError("no rows to fit")
        return found[1] / found[0], found[2:] / found[0]

    return lbfgs(objective, first, max_iter, tolerance)


# ---------------------------------------------------------------- L-BFGS

class SearchFailed(Exception):
    pass


def strong_wolfe(phi: Callable[[float], tuple[float, float]], step: float, rounds: int = 10) -> float:
    """A step that meets the strong Wolfe conditions (1e-4, 0.9), by Breeze's rules."""
    value, slope = phi(0.0)

    def zoom(low, high):
        for _ in range(rounds):
            left, right = (high, low) if low[0] > high[0] else (low, high)
            d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
            d2 = np.sqrt(d1 * d1 - left[2] * right[2])
            width = right[0] - left[0]
            t = right[0] - width * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2)
            t = left[0] + 0.1 * width if t < left[0] + 0.1 * width else left[0] + 0.9 * width if t > left[0] + 0.9 * width else t
            here = (t, *phi(t))
            if here[1] > value + 1e-4 * t * slope or here[1] >= low[1]:
                high = here
            else:
                if abs(here[2]) <= 0.9 * abs(slope):
                    return t
                if here[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = here
        raise SearchFailed

    low, t = (0.0, value, slope), step
    for i in range(rounds):
        here = (t, *phi(t))
        if np.isnan(here[1]) or np.isinf(here[1]):
            t /= 2
            continue
        if here[1] > value + 1e-4 * t * slope or (here[1] >= low[1] and i):
            return zoom(low, here)
        if abs(here[2]) <= 0.9 * abs(slope):
            return t
        if here[2] >= 0:
            return zoom(here, low)
        low, t = here, t * 1.5
    raise SearchFailed


def lbfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float,
          kept: int = 10) -> np.ndarray:
    """Breeze's L-BFGS with the stops that Spark sets."""
    last: list = [None, None]

    def at(point):
        if last[0] is None or not np.array_equal(last[0], point):
            last[:] = [point, objective(point)]
        return last[1]

    value, grad = at(x)
    start, values, history, failed = value, [value], [], False
    for done in range(max_iter + 1):
        if (done >= max_iter or (len(values) > 1 and abs(value - max(values)) <= tolerance * abs(start))
                or np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8)):
            break
        try:
            direction, alphas = grad.copy(), []
            for s, y in reversed(history):
                alphas.append(s @ direction / (s @ y))
                direction -= alphas[-1] * y
            if history:
                direction *= history[-1][0] @ history[-1][1] / (history[-1][1] @ history[-1][1])
            for (s, y), a in zip(history, reversed(alphas)):
                direction += s * (a - y @ direction / (s @ y))
            direction = -direction

            def phi(t):
                v, g = at(x + direction * t)
                return v, float(g @ direction)

            step = strong_wolfe(phi, 1 / np.linalg.norm(direction) if done == 0 else 1.0)
            if step * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            history, failed = [], True
            continue
        new = x + direction * step
        new_value, new_grad = at(new)
        history = [*history, (new - x, new_grad - grad)][-kept:]
        x, value, grad, failed = new, new_value, new_grad, False
        values = [*values, value][-20:]
    return x
