"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard
transform (padded to a power of two) and hashes each to its nearest signed
axis.  Every vector stands in its own bucket of each table; a query probes, in
every table, the ``probes`` axes that lie nearest to it.  A bucket's vectors
and the queries that probe it meet in one task, which takes the exact cosines
of all candidates in double precision and sends on each query's best few, not
the pairs; the best of all buckets are a query's answer.

Buckets have no cap: one with more than ``BLOCK`` vectors is dealt to blocks
by hash of the id, and its queries go to every block.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id, take no part; vectors of another length than the query's
are no candidates (each length is hashed apart); equal scores go to the
smaller id; rows that repeat an id count once (their best score); a query that
the tables lead to fewer than ``nearest`` vectors is compared exactly, in
blocks, with all vectors of its length, so it gets ``nearest`` rows or, if
there are fewer candidates, all of them; without queries or candidates there
are no rows; further columns, whatever their names, take no part.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TABLES, PROBES, NEAREST, BLOCK, SEED = 8, 16, 5, 4096, 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide)."""
    n = 1
    while n < x.shape[1]:
        x = x.reshape(len(x), -1, 2, n)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=-1).reshape(len(x), -1)
        n *= 2
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of signs and transform."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row, nearest first: axis i is
    2i, its opposite 2i + 1."""
    y = rotated(x, table)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors scaled to length 1) of the usable rows, a length at a time."""
    rows: dict[int, list] = {}
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if i is not None and v and None not in v:
            rows.setdefault(len(v), []).append((i, v))
    for own in rows.values():
        ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own], dtype=np.float64)
        peak = np.abs(x).max(axis=1)
        good = np.isfinite(peak) & (peak > 0)
        ids, x = ids[good], x[good] / peak[good, None]
        if len(ids):
            yield ids, x / np.sqrt((x * x).sum(axis=1))[:, None]


def hashed(tables: int, probes: int):
    """Rows (id, vector) to (len, tab, bucket, id, vec), ``probes`` a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                for ids, x in unit_rows(batch.slice(lo, 2048)):
                    raw = [r.tobytes() for r in x]
                    for t in range(tables):
                        axes = nearest_axes(x, t, probes)
                        wide = axes.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(axes.size, x.shape[1], np.int32)), pa.array(np.full(axes.size, t, np.int32)),
                             pa.array(axes.reshape(-1).astype(np.int32)), pa.array(np.repeat(ids, wide), pa.int64()),
                             pa.array([r for r in raw for _ in range(wide)], pa.binary())],
                            names=["len", "tab", "bucket", "id", "vec"])
    return run


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to (len, id, vec)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            for ids, x in unit_rows(batch.slice(lo, 2048)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), x.shape[1], np.int32)), pa.array(ids, pa.int64()),
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["len", "id", "vec"])


HASHED = "len int, tab int, bucket int, id bigint, vec binary"
UNITS = "len int, id bigint, vec binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def compare(nearest: int):
    """Best candidates of one block for each query that probes its bucket."""
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        width = key[0].as_py()
        out: list[list[np.ndarray]] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            # equal vectors are one candidate that stands for its smallest ids
            held: dict[bytes, list[int]] = {}
            for i, raw in sorted(zip(vectors.column("id").to_pylist(), vectors.column("vec").to_pylist())):
                own = held.setdefault(raw, [])
                if len(own) <= nearest and (not own or own[-1] != i):
                    own.append(i)
            x = np.repeat(np.frombuffer(b"".join(held)).reshape(-1, width), [len(v) for v in held.values()], axis=0)
            ids = np.array([i for v in held.values() for i in v])
            asked = queries.column("id").to_numpy()
            q = np.frombuffer(b"".join(queries.column("vec").to_pylist())).reshape(-1, width)
            for lo in range(0, len(q), 64):
                s = q[lo:lo + 64] @ x.T
                s[asked[lo:lo + 64, None] == ids[None, :]] = -np.inf
                least = -2.0
                if s.shape[1] > nearest:  # sums in another order differ in the last places: keep near ties
                    least = np.maximum(-np.partition(-s, nearest - 1, axis=1)[:, nearest - 1:nearest] - 1e-12, least)
                at, col = np.nonzero(s >= least)
                # each pair summed the same way everywhere
                out[2].append(np.einsum("ij,ij->i", q[lo + at], x[col]))
                out[0].append(asked[lo + at])
                out[1].append(ids[col])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})
    return run


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables: int = TABLES,
           probes: int = PROBES, block: int = BLOCK, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query row
    among all rows of ``vectors`` but its own id."""
    def named(df):
        return df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v"))

    index = named(vectors).mapInArrow(hashed(tables, 1), HASHED)
    probe = named(queries).mapInArrow(hashed(tables, probes), HASHED)
    place = ["len", "tab", "bucket"]
    # one number for each bucket: at most tables x twice the dimension rows
    blocks = index.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = index.join(F.broadcast(blocks), place).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = probe.join(F.broadcast(blocks), place).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [*place, "block"]
    found = (dealt.select(*cell, "id", "vec").groupBy(*cell)
             .cogroup(asked.select(*cell, "id", "vec").groupBy(*cell)).applyInArrow(compare(nearest), FOUND))
    best = written(ranked(found, nearest), "neighbours")
    enough = best.where(F.col("rank") == nearest).select(F.col("query_id").alias("id"))
    short = written(named(queries).mapInArrow(units, UNITS).join(enough, "id", "left_anti").select("len", "id", "vec"),
                    "short-queries")
    if short.isEmpty():
        return best
    exact = compared(named(vectors).mapInArrow(units, UNITS), short, nearest, block)
    return ranked(best.select("query_id", "vec_id", "score").unionByName(exact), nearest)


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    """Each query's ``nearest`` best of the pairs found, each pair once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")


def compared(vectors: DataFrame, queries: DataFrame, nearest: int, block: int) -> DataFrame:
    """Best of all vectors of its length for each query: every block of
    vectors meets every block of queries."""
    def parts(df, name):  # one number for each length
        return df.groupBy("len").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    def dealt(df, own, other):
        place = F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")
        return (df.join(F.broadcast(many), "len").withColumn(own, place)
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select(*cell, "id", "vec").groupBy(*cell))

    cell = ["len", "block", "asked"]
    many = parts(vectors, "blocks").join(parts(queries, "askeds"), "len")
    return dealt(vectors, "block", "asked").cogroup(dealt(queries, "asked", "block")).applyInArrow(compare(nearest), FOUND)
