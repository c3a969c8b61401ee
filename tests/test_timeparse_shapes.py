"""The shapes that spare the time parser are no narrower than its layouts."""
from pyspark.sql import functions as F

from ledgerlens.functions import timeparse as FT


def test_shapes_change_no_time(spark, monkeypatch):
    dates = ["2025-03-02", "2025-3-2", "2025/03/02", "2025/3/2", "02/03/2025", "2/3/2025", "12025-03-02", "+12025-03-02", "0012/3/2024", "25-3-2", "-2025/3/2"]
    clocks = ["T09:15:00", "t9:5:0", "T009:15:00", " 09:15:00", " 9:5:0", "  9:5:0", "T24:00:00", "T-0:15:00", " 09:15", "T09:15:00.5", ""]
    tails = ["", "Z", "z", "+0330", "+03:30", "-0000", "+03", "+033015", "+03:30:15", " ", "\n", "x"]
    df = spark.createDataFrame([(d + c + t,) for d in dates for c in clocks for t in tails] + [(None,), ("",)], "t string")

    def times():
        return {r.t: r.u for r in df.select("t", FT.parse_event_time(F.col("t"), stripped=True).cast("string").alias("u")).collect()}
    with_shapes = times()
    assert sum(u is not None for u in with_shapes.values()) > 50
    monkeypatch.setattr(FT, "_LAYOUTS", [(fmt, zoned, "") for fmt, zoned, _ in FT._LAYOUTS])
    assert times() == with_shapes
