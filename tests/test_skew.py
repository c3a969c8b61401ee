"""Joins on hot keys: balanced tasks, unchanged results."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import enrich as E
from ledgerlens.operators import skew as K


@pytest.fixture
def shuffled(spark):
    """No broadcast, and tasks as they are dealt."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    return sorted(r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1))).collect())


def test_a_key_with_a_third_of_the_rows_is_dealt(shuffled):
    spark = shuffled
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
                                      F.lit(1).alias("b"))
    each = rows.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    hot = K.hot_keys(rows, {"b": ["k", "b"]})["b"]
    assert len(hot) == 1 and list(hot.values())[0] > 8
    plain, dealt = rows.join(each, ["k", "b"], "left"), K.salted_join(rows, each, ["k", "b"], hot)
    before, after = sizes(plain), sizes(dealt)
    assert sum(after) == 30_000 and before[-1] > 3 * np.median(before) and after[-1] < 2 * np.median(after)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.select(plain.columns).collect()))


def test_wrong_or_missing_keys_change_no_result(shuffled):
    rows = shuffled.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, x int")
    each = rows.groupBy("k").agg(F.sum("x").alias("s"))
    want = sorted(map(repr, rows.join(each, ["k"], "left").collect()))
    a = rows.where("k = 'a'").select(K.key_hash(["k"])).first()[0]
    for hot in ({}, {a: 5}, {12345: 7}, {a: 1}):
        assert sorted(map(repr, K.salted_join(rows, each, ["k"], hot).collect())) == want
    assert K.hot_keys(rows.limit(0), {"k": ["k"]}) == {"k": {}}


def test_features_of_a_hot_account(shuffled):
    spark = shuffled
    i = F.col("id")
    tx = spark.range(6000).select(
        F.concat(F.lit("T"), i).alias("transaction_id"), F.timestamp_seconds(i * 5).alias("event_time"),
        F.when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("A"), i % 700)).alias("account_number"), F.concat(F.lit("C"), i % 50).alias("card_pan"),
        F.when(i % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("I"), i % 9)).cast("string").alias("ip_address"),
        F.concat(F.lit("D"), i % 2).alias("device_fp_hash"), (i * 1_000_000).alias("amount_rial"),
        F.when(i % 4 == 0, "FAILED").otherwise("SUCCESS").alias("result"))
    got = {r.transaction_id: r for r in E.attach_features(tx).collect()}
    assert len(got) == 6000
    rows = tx.collect()
    day = [r for r in rows if r.account_number == "HOT" and r.event_time.timestamp() < 86400]
    assert {got[r.transaction_id].acc_total_amount_24h for r in day} == {sum(r.amount_rial for r in day)}
    assert all((got[r.transaction_id].ip_unique_cards_1h is None) == (r.ip_address is None) for r in rows)
    hour = [r for r in rows if r.device_fp_hash == "D1" and 3600 <= r.event_time.timestamp() < 7200]
    assert {got[r.transaction_id].dev_unique_cards_1h for r in hour} == {len({r.card_pan for r in hour})}
