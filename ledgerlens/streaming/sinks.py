"""Idempotent sinks of streaming jobs: rows by batch id, and one manifest a batch.

A batch's rows go to ``<folder>/rows/batch=<id>`` (a replay overwrites them),
then its manifest with the counters that were observed while the rows were
written.  Readers take committed batches only, so they never see a batch
half written.  Counters add up over the manifests: replays cannot count twice.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config
from .state import Files


class BatchSink:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def write(self, batch: int, rows: DataFrame, counters: dict[str, Column] | None = None, also: dict | None = None,
              by: str | None = None) -> dict:
        """Write and commit a batch, one folder a value of ``by``; returns its counters."""
        target = f"{self.folder}/rows/batch={batch:012d}"
        counted = dict(also or {})
        if counters:
            seen = Observation()
            rows = rows.observe(seen, *[c.alias(n) for n, c in counters.items()])
        rows.write.mode("overwrite").partitionBy(*([by] if by else [])).parquet(target)
        if counters:
            counted |= seen.get
        self.files.put(f"{self.folder}/manifest/{batch:012d}.json", json.dumps(counted, sort_keys=True))
        return counted

    def batches(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json")]

    def batch(self, batch: int) -> DataFrame:
        """The rows of one written batch."""
        return self.spark.read.parquet(f"{self.folder}/rows/batch={batch:012d}")

    def read(self, schema=None) -> DataFrame:
        """The rows of all committed batches, with their ``batch`` id."""
        paths = [f"{self.folder}/rows/batch={b:012d}" for b in self.batches()]
        if not paths:
            if schema is None:
                raise FileNotFoundError(f"{self.folder} holds no committed batch")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.folder}/rows")
        return (reader.schema(schema) if schema else reader).parquet(*paths)

    def counters(self) -> DataFrame:
        """One row a committed batch: ``batch`` and its counters (one JSON text
        each in ``counters``)."""
        rows = [(b, self.files.text(f"{self.folder}/manifest/{b:012d}.json")) for b in self.batches()]
        return self.spark.createDataFrame(rows, "batch bigint, counters string")


def decision_counters() -> dict[str, Column]:
    """What is counted of every batch of decisions."""
    return {"total_tx": F.count(F.lit(1)), "blocked": F.count_if("should_block"),
            **{level: F.count_if(F.col("risk_level") == level) for level in config.RISK_LEVELS}}


def ingest_counters() -> dict[str, Column]:
    """Ok and dead-letter rows of a batch of validated rows."""
    return {"ok": F.count_if(F.col("error").isNull()), "dlq": F.count_if(F.col("error").isNotNull())}


def totals(sink: BatchSink, names: list[str]) -> DataFrame:
    """One row: the counters of all committed batches added up, and ``batches``."""
    parsed = F.from_json("counters", ", ".join(f"`{n}` bigint" for n in names))
    rows = sink.counters().select(parsed.alias("c"))
    return rows.agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in names], F.count(F.lit(1)).alias("batches"))


def write_decisions(sink: BatchSink, batch: int, decisions: DataFrame, also: dict | None = None) -> dict:
    """The decisions of a batch."""
    return sink.write(batch, decisions, decision_counters(), also)


def write_dlq(sink: BatchSink, batch: int, dead: DataFrame) -> dict:
    """The dead letters of a batch."""
    return sink.write(batch, dead, {"dlq": F.count(F.lit(1))})
