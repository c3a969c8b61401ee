"""Keyed tables kept by micro-batches: delta logs by hash bucket, merged in tiers.

A batch appends its rows (one a key) as a segment, split by the hash of the
key into buckets; only buckets that it touches get files.  When ``FAN`` segments
of a bucket have the same level they are merged into one of the next level, so
a row is rewritten once a level, not once a batch, and a read meets fewer than
``FAN`` segments a level.  Merged segments follow each other in time; ``seq``, the
newest batch in a row, keeps their order.

One manifest a batch names the segments of every bucket.  A batch builds on the
newest manifest before it and never on its own: a replay writes the same files
and the same manifest.  Readers see committed manifests only.  Segments that
neither the newest manifest nor the one before names are deleted.

A bucket must fit a task; ``buckets`` is fixed when a folder is made.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import Files

BUCKETS = 64
FAN = 4

#: bucket -> its segments, oldest first, as [folder, level]
Segments = dict[str, list[list]]


@dataclass(frozen=True)
class Table:
    """Key columns, and how the other columns of one key's rows merge.  The
    aggregates may order rows by ``seq``."""
    schema: str
    keys: tuple[str, ...]
    merge: Callable[[], dict[str, Column]] = dict


def newest(column: str) -> Column:
    """The value of the newest batch that has one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))


def oldest(column: str) -> Column:
    """The value of the oldest batch that has one."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))


def due(levels: list[int], fan: int = FAN) -> tuple[int, int]:
    """(how many of the newest segments merge, the level of the result); zero
    segments if fewer than ``fan`` share the newest level."""
    stack = [(level, 1) for level in levels]
    while len(stack) >= fan and len({level for level, _ in stack[-fan:]}) == 1:
        level = stack[-1][0]
        covered = sum(n for _, n in stack[-fan:])
        stack[-fan:] = [(level + 1, covered)]
    level, covered = stack[-1] if stack else (0, 0)
    return (covered, level) if covered > 1 else (0, level)


class MergeLog:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self.buckets, self.fan, self.files = buckets, fan, Files(spark)

    # ------------------------------------------------------------ manifests

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json"))

    def manifest(self, batch: int | None) -> dict[str, Segments]:
        """Segments of every table as of a committed batch (None: nothing)."""
        if batch is None:
            return {t: {} for t in self.tables}
        stored = json.loads(self.files.text(f"{self.folder}/manifest/{batch:012d}.json"))
        if stored["buckets"] != self.buckets:
            raise ValueError(f"{self.folder} has {stored['buckets']} buckets, not {self.buckets}")
        return stored["tables"]

    def _before(self, batch: int) -> int | None:
        """The batch that ``batch`` builds on; refuses another checkpoint's folder."""
        ids = self.batches()
        if ids and ids[-1] > batch:
            raise FileExistsError(f"{self.folder} holds batch {ids[-1]} of another checkpoint")
        earlier = [b for b in ids if b < batch]
        if batch and not earlier:
            raise FileNotFoundError(f"{self.folder} lacks what batch {batch} builds on")
        return earlier[-1] if earlier else None

    # ---------------------------------------------------------------- rows

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _rows(self, table: str, paths: list[str]) -> DataFrame:
        schema = self.tables[table].schema + ", seq bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, table: str, rows: DataFrame, *by: str) -> DataFrame:
        spec = self.tables[table]
        values = [c.alias(name) for name, c in spec.merge().items()]
        return rows.groupBy(*by, *spec.keys).agg(*values, F.max("seq").alias("seq"))

    def _write(self, table: str, segment: str, rows: DataFrame) -> list[str]:
        """Write bucketed rows as a segment; returns the buckets it has files in."""
        target = f"{self.folder}/{table}/{segment}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(target)
        return [n.removeprefix("bucket=") for n in self.files.names(target) if n.startswith("bucket=")]

    def _paths(self, table: str, bucket: str, segments: list[list]) -> list[str]:
        return [f"{self.folder}/{table}/{name}/bucket={bucket}" for name, _ in segments]

    def append(self, batch: int, rows: dict[str, DataFrame]) -> None:
        """Commit a batch: its rows of every table, one a key."""
        before = self._before(batch)
        merged = []
        tables = {t: {b: list(s) for b, s in segments.items()} for t, segments in self.manifest(before).items()}
        for table, delta in rows.items():
            spec, segments = self.tables[table], tables[table]
            columns = [F.col(f"`{n}`") for n in self._rows(table, []).columns if n != "seq"]
            delta = delta.select(*columns, F.lit(batch).cast("bigint").alias("seq"), self._bucket(table))
            for b in self._write(table, f"delta-{batch:012d}", delta.repartition("bucket")):
                segments.setdefault(b, []).append([f"delta-{batch:012d}", 0])
            merges = {b: due([level for _, level in s], self.fan) for b, s in segments.items()}
            merges = {b: m for b, m in merges.items() if m[0]}
            if merges:
                old = [p for b, (n, _) in merges.items() for p in self._paths(table, b, segments[b][-n:])]
                # hashed by bucket once: the aggregate and the write need no other exchange
                keyed = self._rows(table, old).withColumn("bucket", self._bucket(table)).repartition("bucket")
                self._write(table, f"merged-{batch:012d}", self._merged(table, keyed, "bucket"))
                merged += [(table, b) for b, s in segments.items() if b in merges and s[-1][0] == f"delta-{batch:012d}"]
                for b, (n, level) in merges.items():
                    segments[b][-n:] = [[f"merged-{batch:012d}", level]]
        text = json.dumps({"buckets": self.buckets, "tables": tables}, sort_keys=True)
        self.files.put(f"{self.folder}/manifest/{batch:012d}.json", text)
        self._retire(batch, before, merged)

    def read(self, table: str, batch: int | None = None) -> DataFrame:
        """The merged rows of a table as of a committed batch (the newest)."""
        ids = self.batches()
        segments = self.manifest(batch if batch is not None else ids[-1] if ids else None)[table]
        paths = [p for b, s in sorted(segments.items()) for p in self._paths(table, b, s)]
        return self._merged(table, self._rows(table, paths)).drop("seq")

    def _retire(self, batch: int, before: int | None, merged: list[tuple[str, str]]) -> None:
        """Delete older manifests and what only they name, and the deltas that
        their own batch merged.  A replay of ``batch`` reads the one before,
        which stays."""
        for table, b in merged:
            self.files.delete(f"{self.folder}/{table}/delta-{batch:012d}/bucket={b}")
        kept = [self.manifest(b) for b in (batch, before) if b is not None]
        live = {t: {(b, name) for m in kept for b, s in m[t].items() for name, _ in s} for t in self.tables}
        for old in [b for b in self.batches() if b not in (batch, before)]:
            for table, segments in self.manifest(old).items():
                for b, name in {(b, name) for b, s in segments.items() for name, _ in s} - live[table]:
                    self.files.delete(f"{self.folder}/{table}/{name}/bucket={b}")
            self.files.delete(f"{self.folder}/manifest/{old:012d}.json")
        for table in self.tables:  # folders without a live bucket
            for name in set(self.files.names(f"{self.folder}/{table}")) - {name for _, name in live[table]}:
                self.files.delete(f"{self.folder}/{table}/{name}")
