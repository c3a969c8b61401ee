"""Keyed, expiring state of ``foreachBatch`` jobs, committed by batch id.

A state folder holds named tables.  Batch ``b`` writes its own rows of every
table under ``data/<table>/batch=<b>`` and then one commit file with its
numbers (times, counts).  It reads only what batches before it committed, so a
batch that is replayed after a crash, before or after its commit, reads the same
state, and writes the same rows in the same place: nothing counts twice.

Every ``COMPACT`` batches the rows that are still needed are merged into one
base (``base/<table>/batch=<b>``); later batches read the newest base before
them and the deltas after it, so a read touches a bounded number of folders.
Bases and deltas that no replay can need any more are deleted (``retire``).
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Batches between two bases.
COMPACT = 16


class Files:
    """The few file operations a state needs, on any file system Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        p = self.path(name)
        return bool(p.getFileSystem(self.conf).exists(p))

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        fs = p.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def text(self, name: str) -> str:
        p = self.path(name)
        stream = p.getFileSystem(self.conf).open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file whole: under another name first, then renamed."""
        p, tmp = self.path(name), self.path(name + ".part")
        fs = p.getFileSystem(self.conf)
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise OSError(f"cannot commit {name}")

    def delete(self, name: str) -> None:
        p = self.path(name)
        p.getFileSystem(self.conf).delete(p, True)


class BatchState:
    """State tables under one folder; ``schemas`` names them."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], compact: int = COMPACT):
        self.spark, self.folder, self.schemas, self.compact = spark, folder.rstrip("/"), schemas, compact
        self.files = Files(spark)

    def _commits(self, kind: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/{kind}") if n.endswith(".json"))

    def metas(self, before: int) -> dict[int, dict]:
        """Numbers of the committed batches before one, by id."""
        return {b: json.loads(self.files.text(f"{self.folder}/commits/{b:012d}.json")) for b in self._commits("commits") if b < before}

    def last(self, before: int) -> dict | None:
        """Numbers of the newest committed batch before one."""
        ids = [b for b in self._commits("commits") if b < before]
        return json.loads(self.files.text(f"{self.folder}/commits/{ids[-1]:012d}.json")) if ids else None

    def read(self, table: str, before: int) -> DataFrame:
        """Rows of the newest base before a batch and the deltas after it."""
        base = max((b for b in self._commits("bases") if b < before), default=None)
        ids = [b for b in self._commits("commits") if b < before and (base is None or b > base)]
        paths = [f"{self.folder}/data/{table}/batch={b:012d}" for b in ids]
        if base is not None:
            paths.append(f"{self.folder}/base/{table}/batch={base:012d}")
        if not paths:
            none = StructType.fromDDL(self.schemas[table])  # no Python workers for no rows
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def check(self, batch: int) -> None:
        """Refuse a folder that another checkpoint wrote: only the newest batch
        is ever replayed."""
        later = [b for b in self._commits("commits") if b > batch]
        if later:
            raise FileExistsError(f"{self.folder} holds batch {later[-1]} of another checkpoint")
        if batch and not self._commits("commits"):
            raise FileNotFoundError(f"{self.folder} lacks what batch {batch} builds on")

    def write(self, batch: int, tables: dict[str, DataFrame], meta: dict) -> None:
        """Write a batch's rows of every table, then commit it."""
        self.put(batch, tables)
        self.commit(batch, meta)

    def put(self, batch: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write a batch's rows of every table and read them back; no other
        batch sees them before ``commit``.  Columns beside the schema's are not state."""
        back = {}
        for table, rows in tables.items():
            target = f"{self.folder}/data/{table}/batch={batch:012d}"
            rows.write.mode("overwrite").parquet(target)
            back[table] = self.spark.read.schema(rows.schema).parquet(target)
        return back

    def commit(self, batch: int, meta: dict) -> None:
        self.files.put(f"{self.folder}/commits/{batch:012d}.json", json.dumps(meta, sort_keys=True))

    def kept(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Rows that a batch uses several times, written and read back; those
        of the batch before last go."""
        target = f"{self.folder}/{name}/batch={batch:012d}"
        rows.write.mode("overwrite").parquet(target)
        if batch > 1:
            self.files.delete(f"{self.folder}/{name}/batch={batch - 2:012d}")
        return self.spark.read.schema(rows.schema).parquet(target)

    def fold(self, batch: int, merge: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """After a batch: merge all rows up to it into a new base when due."""
        bases = self._commits("bases")
        since = [b for b in self._commits("commits") if b <= batch and (not bases or b > bases[-1])]
        if len(since) < self.compact:
            return
        for table in self.schemas:
            rows = merge[table](self.read(table, batch + 1))
            rows.write.mode("overwrite").parquet(f"{self.folder}/base/{table}/batch={batch:012d}")
        self.files.put(f"{self.folder}/bases/{batch:012d}.json", "{}")
        self.retire(batch)

    def retire(self, batch: int) -> None:
        """Delete what lies before the last base but one: a batch that may
        still be replayed reads that one or later."""
        bases = [b for b in self._commits("bases") if b <= batch]
        if len(bases) < 2:
            return
        keep = bases[-2]
        for table in self.schemas:
            for kind, upto in (("data", keep), ("base", keep - 1)):
                for name in self.files.names(f"{self.folder}/{kind}/{table}"):
                    if name.startswith("batch=") and int(name[6:]) <= upto:
                        self.files.delete(f"{self.folder}/{kind}/{table}/{name}")
        for b in bases[:-2]:
            self.files.delete(f"{self.folder}/bases/{b:012d}.json")
