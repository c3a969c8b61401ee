"""Small helpers shared by the text operators."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside one task are cut to groups of about this many
#: bytes, so memory follows the setting and not the number of rows in a batch.
GROUP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_groups(col: pa.Array, limit: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column holding about ``limit`` bytes each (a longer
    single text is a slice of its own)."""
    n = len(col)
    if n == 0:
        return
    sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield col.slice(start, i - start)
            start, held = i, 0
        held += size
    yield col.slice(start, n - start)


def over_texts(make: Callable[[], Callable[[list[str]], pa.Array]]):
    """Iterator body of an Arrow function on one string column: builds the
    worker's function once, then feeds it byte-balanced groups of texts."""
    def run(batches):
        work = make()
        for col in batches:
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            parts = [work([x or "" for x in part.to_pylist()]) for part in byte_groups(col)]
            yield pa.concat_arrays(parts) if parts else work([])
        trim()
    return run


def trim() -> None:
    """Give back memory that a finished task has freed: workers live on, and
    what their allocators keep would count against the executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lists(flat, lengths, kind: pa.DataType) -> pa.Array:
    """list<kind> from the concatenated values and the length of each row."""
    import numpy as np
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder ``spark.checkpoint.dir``; a
    local one is made only for a local session that names none (tests)."""
    import tempfile
    import uuid
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha256_of_ints(ids) -> F.Column:
    """Lowercase hex SHA-256 of decimal numbers joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file (installed on every machine)."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
