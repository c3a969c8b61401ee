"""Replays of tables as streams: a micro-batch is read by many tasks."""
from pyspark.sql import functions as F

from ledgerlens.plans import q_stream as Q


def test_batches_are_ranges_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 50)
    rows = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("x"))
    stream = Q._ordered_replay(spark, rows, "x", str(tmp_path), 4)
    seen = []

    def write(batch, batch_id):
        seen.append((batch.select(F.input_file_name()).distinct().count(), *batch.agg(F.min("x"), F.max("x"), F.count("*")).first()))
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert len(seen) == 4
    assert all(files > 1 for files, *_ in seen)
    assert sum(n for *_, n in seen) == 2000
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
