"""The clean table is cut into files, so that many tasks read what one task wrote."""
from pyspark.sql import functions as F

from ledgerlens.operators import ingest as IN


def test_one_partition_is_read_by_many_tasks(spark, tmp_path):
    rows = 4 * IN.CLEAN_FILE_ROWS - 1
    IN.write_clean_table(spark.range(0, rows, 1, 1).withColumn("x", F.col("id") * 2), str(tmp_path / "clean"))
    back = spark.read.parquet(str(tmp_path / "clean"))
    sizes = [r.n for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == rows
