"""JSON payload source with envelope unwrap.

A body may be a JSON list of records, an object wrapping the list under one
of ``transactions``, ``data``, ``records``, ``items`` (first present key
wins), or a single record.  Files with one record per line are read as
NDJSON.  Each output row is one record as JSON text (``payload``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_KEYS = ["transactions", "data", "records", "items"]


def unwrap(bodies: DataFrame, body_col: str = "value") -> DataFrame:
    """One row per record from a column of response bodies."""
    b = F.trim(F.col(body_col))
    as_list = F.from_json(b, "array<string>")
    env_schema = "struct<" + ",".join(f"{k}:array<string>" for k in ENVELOPE_KEYS) + ">"
    env = F.from_json(b, env_schema)
    keys = F.json_object_keys(b)
    # first key of the fixed order that is present (even if its list is empty)
    wrapped = None
    for k in reversed(ENVELOPE_KEYS):
        pick = F.when(F.array_contains(keys, k), F.coalesce(env[k], F.array().cast("array<string>")))
        wrapped = pick if wrapped is None else pick.otherwise(wrapped)
    records = (F.when(b.startswith("["), as_list)
                .when(b.startswith("{"), F.coalesce(wrapped, F.array(b))))
    return bodies.select(F.explode(records).alias("payload"))


def read_raw_json(spark: SparkSession, path: str, streaming: bool = False,
                  ndjson: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed API responses -> ``payload`` rows (batch or stream)."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if ndjson:
        lines = reader.text(path)
        return lines.filter(F.length(F.trim("value")) > 0).select(F.trim("value").alias("payload"))
    bodies = reader.option("wholetext", True).text(path)
    return unwrap(bodies)
