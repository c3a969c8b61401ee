"""Session helpers.

The library never hard-codes cluster settings; it only pins what the
semantics depend on (UTC session time zone) and fills in a checkpoint
directory when the session does not name one (local tests only).
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session's time zone to UTC, which results depend on; every
    other setting stays the caller's.  Safe to call repeatedly."""
    # hour(), window() alignment and text rendering all assume UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared file system; it is
    read from the session.  Only when it is unset (local runs, tests) a fresh
    scratch folder is created and registered.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df``, written to a scratch table and read back: what reads it several
    times computes it once."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
