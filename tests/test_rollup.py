"""Features rolled up from hourly partials, in batch and stream."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import rollup as R
from ledgerlens.streaming import rollups as RS
from ledgerlens.streaming.state import BatchState

SCHEMA = ("s double, card_pan string, account_number string, national_code string, mobile_e164 string, ip_address string, "
          "device_fp_hash string, amount_rial long, result string, is_night boolean, is_carrier_nat boolean")


def frame(spark, seconds, seed=0):
    rng = np.random.default_rng(seed)

    def pick(prefix, n):
        k = int(rng.integers(0, n + 1))
        return None if k == n else f"{prefix}{k}"
    rows = [(float(t), pick("c", 3), pick("a", 3), pick("n", 4), pick("m", 4), pick("i", 3), pick("d", 3),
             None if rng.random() < 0.1 else int(rng.integers(1, 10 ** 11)), ["FAILED", "SUCCESS", None][rng.integers(0, 3)],
             [True, False, None][rng.integers(0, 3)], [True, False, None][rng.integers(0, 3)]) for t in seconds]
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def as_rows(df):
    names = sorted(df.columns)
    return sorted(repr([round(v, 5) if isinstance(v, float) else v for v in (r[c] for c in names)]) for r in df.collect())


@pytest.mark.parametrize("entity", list(FE.ENTITIES))
def test_rollup_equals_direct_features(spark, entity):
    tx = frame(spark, np.random.default_rng(1).uniform(-9e5, 9e5, 400))  # before 1970 too
    got = R.rolled_up(R.hourly(tx, entity), R.hourly_values(tx, entity), entity)
    want = FE.entity_features(tx, entity)
    assert sorted(got.columns) == sorted(want.columns)
    relative = [c for c in got.columns if c.endswith(("avg_amount", "std_amount"))]
    rounded = {c: F.round(F.col(c) / 1000, 3) for c in relative}
    assert as_rows(got.withColumns(rounded)) == as_rows(want.withColumns(rounded))
    none = tx.limit(0)
    assert R.rolled_up(R.hourly(none, entity), R.hourly_values(none, entity), entity).count() == 0


def test_moments_do_not_cancel(spark):
    tx = frame(spark, [10.0, 20.0, 30.0]).withColumn("amount_rial", F.lit(499_999_999_999) + F.unix_micros("event_time") / 10_000_000)
    got = R.rolled_up(R.hourly(tx, "card"), R.hourly_values(tx, "card"), "card", ["1 hour"])
    assert {r.card_std_amount for r in got.where("card_tx_count = 1").collect()} <= {None}
    same = R.rolled_up(R.hourly(tx.withColumn("card_pan", F.lit("c")), "card"), R.hourly_values(tx, "card"), "card", ["1 hour"]).first()
    assert abs(same.card_std_amount - 1.0) < 1e-9


def test_batches_touch_windows_and_late_rows_do_not(spark, tmp_path):
    hours = [np.linspace(0, 3500, 12), np.linspace(3600, 20_000, 25), np.array([25_000.0, 30_000.0]), np.array([100.0, 29_000.0]),
             np.linspace(90_000, 95_000, 6)]
    parts = [frame(spark, t, i) for i, t in enumerate(hours)]
    state, out, late = BatchState(spark, f"{tmp_path}/s", RS.SCHEMAS, compact=2), {}, []

    def run(i):
        def emit(rows, n):
            late.append(n)
            for r in rows.collect():
                out[r.entity_id, r.window_duration, r.window_start] = r
        RS.roll_batch(parts[i], i, "card", state, emit)
    for i in (0, 1, 1, 2, 3, 4):  # batch 1 is replayed
        run(i)
    # the row at 100 s is late for the windows of an hour and of six, which ended
    # before 30,000 - 3,600 s, and counts in those of a day and of seven
    assert late == [0, 0, 0, 0, 2, 0]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    want = {(r.entity_id, r.window_duration, r.window_start): r for r in FE.entity_features(union, "card").collect()}
    without = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3].where(F.unix_micros("event_time") > 1_000_000_000)).unionByName(parts[4])
    closed = {(r.entity_id, r.window_duration, r.window_start): r for r in FE.entity_features(without, "card", ["1 hour", "6 hours"]).collect()}
    for key, r in out.items():
        expected = closed[key] if key[1] in ("1 hour", "6 hours") else want[key]
        assert (r.card_tx_count, r.card_total_amount, r.card_unique_ips) == (expected.card_tx_count, expected.card_total_amount, expected.card_unique_ips)
    assert out.keys() == {k for k in want if k[1] not in ("1 hour", "6 hours")} | closed.keys()


def test_values_new_in_a_window_add_up_to_its_distinct_count(spark):
    hours = [-1, 0, 0, 1, 5, 6, 7, 23, 24, 71, 72, 167, 168]
    rows = [(k, h, c, v) for k in ("a", "b", None) for i, h in enumerate(hours) for c in ("account_number", "ip_address") for v in {f"v{i % 3}", f"w{i % 5}"}]
    values = spark.createDataFrame(rows + rows[::3], "entity_id string, h long, kind string, value string")  # repeated rows too
    values = values.withColumn("hour", F.timestamp_micros(F.col("h") * 3_600_000_000)).drop("h")
    windows = ["6 hours", "7 days"]
    keys = ["entity_id", "window_duration", "window_start"]
    new = R.in_windows(R.firsts(values, "card", windows), windows)
    sums = new.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in new.columns if c.startswith("card_")]).collect()
    got = {tuple(r[k] for k in keys): [r[f"{n}_{windows.index(r.window_duration)}"] for n in R.DISTINCT["card"]] for r in sums}
    want = R.in_windows(values, windows).groupBy(*keys).agg(*[F.countDistinct(F.when(F.col("kind") == c, F.col("value"))).alias(c)
                                                             for c in ("account_number", "ip_address", "device_fp_hash")])
    assert got == {tuple(r[k] for k in keys): list(r[3:]) for r in want.collect()}


def test_a_micro_batch_is_read_once_for_partials_and_once_for_values(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            read.add(p.num_rows)
            yield p
    tx = frame(spark, np.linspace(0, 50_000, 40))
    seen = []
    RS.roll_batch(tx.mapInArrow(counted, tx.schema), 0, "ip", BatchState(spark, f"{tmp_path}/s", RS.SCHEMAS), lambda rows, n: seen.append(as_rows(rows)))
    assert read.value == 2 * 40
    RS.roll_batch(tx, 0, "ip", BatchState(spark, f"{tmp_path}/t", RS.SCHEMAS), lambda rows, n: seen.append(as_rows(rows)))
    assert seen[0] == seen[1]


def test_streams_carry_the_columns_they_use(spark, tmp_path, monkeypatch):
    frame(spark, [1.0, 2.0]).withColumn("raw", F.lit("x")).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/src").schema).parquet(f"{tmp_path}/src")
    seen = {}
    monkeypatch.setattr(RS, "roll_batch", lambda batch, batch_id, entity, *rest: seen.update({entity: batch.columns}))
    RS.watch(spark, RS.start_rollups(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", trigger={"availableNow": True}))
    assert seen == {e: R.needed(e) for e in FE.ENTITIES}
    assert not any("raw" in c or "mobile_e164" in c for e, c in seen.items() if e != "account")


def test_a_failing_query_stops_the_others(spark, tmp_path):
    frame(spark, [1.0, 2.0]).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/src").schema).parquet(f"{tmp_path}/src")
    queries = RS.start_rollups(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["card", "ip"], trigger={"processingTime": "1 second"})

    def fails(batch, batch_id):
        raise RuntimeError("lost")
    queries["bad"] = stream.writeStream.option("checkpointLocation", f"{tmp_path}/bad").foreachBatch(fails).start()
    with pytest.raises(Exception):
        RS.watch(spark, queries)
    assert not any(q.isActive for q in queries.values())


def test_watch_does_not_raise_for_older_queries(spark, tmp_path):
    frame(spark, [1.0, 2.0]).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/src").schema).parquet(f"{tmp_path}/src")

    def fails(batch, batch_id):
        raise RuntimeError("lost")
    with pytest.raises(Exception):
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/bad").foreachBatch(fails).start().awaitTermination()
    RS.watch(spark, RS.start_rollups(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["ip"], trigger={"availableNow": True}))
    assert RS.current(spark, f"{tmp_path}/out", "ip").count() > 0
