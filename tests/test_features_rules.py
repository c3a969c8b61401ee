"""Feature fixture, rules at and around every threshold, decisions."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators.decision import decide
from ledgerlens.operators.rules import evaluate_rules

CARD, CARD2, CARD3 = "5022291111111118", "5859837777777770", "6274129999999994"
ROWS = [
    ("P-1", "2025-03-02 04:10:00", 2100000, CARD, "S-10", "0499370899", "+989351234567", "91.98.4.7", False, 1.0, "dv-1", "POS", "SUCCESS", False),
    ("P-2", "2025-03-02 04:20:00", 1300000, CARD, "S-11", "0499370899", "+989351234567", "91.98.4.7", False, 1.0, "dv-1", "POS", "FAILED", False),
    ("P-3", "2025-03-02 04:50:00", 1200000, CARD, "S-10", "0499370899", "+989351234567", "91.98.4.8", False, 1.0, "dv-2", "WEB", "FAILED", False),
    ("P-4", "2025-03-02 04:55:00", 900000, CARD, "S-12", "0499370899", "+989351234567", "91.98.4.8", False, 1.0, "dv-2", "WEB", "SUCCESS", False),
    ("P-5", "2025-03-02 21:05:00", 310000000, CARD2, "S-30", "1234567891", "+989352222222", "10.20.0.9", True, 0.3, "dv-3", "ATM", "SUCCESS", True),
    ("P-6", "2025-03-02 22:40:00", 90000000, CARD3, "S-40", "0084575948", "+989353333333", "91.98.4.7", False, 1.0, "dv-1", "POS", "SUCCESS", True),
]
SCHEMA = ("transaction_id string, ts string, amount_rial long, card_pan string, account_number string, "
          "national_code string, mobile_e164 string, ip_address string, is_carrier_nat boolean, "
          "ip_confidence double, device_fp_hash string, channel string, result string, is_night boolean")


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("event_time", F.col("ts").cast("timestamp"))


def feat(tx, entity, key, win, metric):
    f = FE.entity_features(tx, entity, [win])
    return [r[metric] for r in f.filter(F.col("entity_id") == key).collect()]


def test_card_features(tx):
    assert feat(tx, "card", CARD, "1 hour", "card_tx_count") == [4]
    assert feat(tx, "card", CARD, "1 hour", "card_unique_accounts") == [3]
    assert feat(tx, "card", CARD, "1 hour", "card_fail_ratio") == [0.5]
    assert feat(tx, "card", CARD2, "1 hour", "card_night_ratio") == [1.0]


def test_other_entities(tx):
    assert feat(tx, "account", "S-10", "1 hour", "acc_tx_count") == [2]
    assert feat(tx, "account", "S-10", "24 hours", "acc_small_tx_count") == [2]
    assert feat(tx, "ip", "91.98.4.7", "24 hours", "ip_unique_cards") == [2]
    assert feat(tx, "ip", "10.20.0.9", "24 hours", "ip_nat_ratio") == [1.0]
    assert feat(tx, "device", "dv-1", "24 hours", "dev_unique_cards") == [2]
    assert feat(tx, "device", "dv-2", "24 hours", "dev_tx_count") == [2]


def test_stream_window_equals_batch_buckets(tx):
    a = FE.window_features(tx, "card", "1 hour", distinct="exact").select(
        "entity_id", F.col("window.start").alias("s"), "card_tx_count")
    b = FE.entity_features(tx, "card", ["1 hour"]).select("entity_id", F.col("window_start").alias("s"),
                                                          "card_tx_count")
    assert sorted(a.collect()) == sorted(b.collect())


BASE = dict(transaction_id="P-9", amount_rial=1_500_000, card_pan=CARD, account_number="S-10",
            ip_address="91.98.4.7", device_fp_hash="dv-hash-12", is_night=False, ip_confidence=1.0,
            acc_total_amount_24h=0, acc_small_tx_count_24h=0, ip_unique_cards_1h=1, dev_unique_cards_1h=1,
            acc_fail_ratio_1h=0.0, card_unique_accounts_24h=1, account_type="normal")
RULE_SCHEMA = ("transaction_id string, amount_rial long, card_pan string, account_number string, ip_address string, "
               "device_fp_hash string, is_night boolean, ip_confidence double, acc_total_amount_24h long, "
               "acc_small_tx_count_24h long, ip_unique_cards_1h long, dev_unique_cards_1h long, "
               "acc_fail_ratio_1h double, card_unique_accounts_24h long, account_type string")


def rules(spark, **kw):
    r = dict(BASE)
    r.update(kw)
    df = spark.createDataFrame([tuple(r[k] for k in BASE)], RULE_SCHEMA)
    return evaluate_rules(df).first()


def codes(row):
    return [(a.rule_code, a.severity) for a in row.alerts]


@pytest.mark.parametrize("kw,acct,expect", [
    (dict(amount_rial=400_000_000), "normal", []),
    (dict(amount_rial=500_000_000), "normal", []),
    (dict(amount_rial=600_000_000), "normal", [("R001", "high")]),
    (dict(amount_rial=600_000_000), "commercial", []),
    (dict(amount_rial=5_000_000_000), "vip", []),
    (dict(acc_total_amount_24h=1_000_000_000), "normal", []),
    (dict(acc_total_amount_24h=2_000_000_000), "normal", []),
    (dict(acc_total_amount_24h=3_000_000_000), "normal", [("R002", "high")]),
    (dict(amount_rial=480_000_000, acc_small_tx_count_24h=4), "normal", [("R003", "high")]),
    (dict(amount_rial=480_000_000, acc_small_tx_count_24h=3), "normal", [("R003", "high")]),
    (dict(amount_rial=480_000_000, acc_small_tx_count_24h=2), "normal", []),
    (dict(ip_unique_cards_1h=3), "normal", [("R004", "medium")]),
    (dict(ip_unique_cards_1h=6), "normal", [("R004", "high")]),
    (dict(dev_unique_cards_1h=3), "normal", [("R005", "medium")]),
    (dict(amount_rial=1_200_000_000, is_night=True), "normal", [("R001", "high"), ("R006", "medium")]),
    (dict(amount_rial=1_000_000_000, is_night=True), "normal", [("R001", "high"), ("R006", "medium")]),
    (dict(amount_rial=100_000_000, is_night=True), "normal", []),
    (dict(acc_fail_ratio_1h=0.5), "normal", [("R007", "medium")]),
    (dict(acc_fail_ratio_1h=0.4), "normal", [("R007", "medium")]),
    (dict(acc_fail_ratio_1h=0.1), "normal", []),
    (dict(card_unique_accounts_24h=3), "normal", [("R008", "medium")]),
])
def test_rule_thresholds(spark, kw, acct, expect):
    row = rules(spark, account_type=acct, **kw)
    assert codes(row) == expect


def test_scores(spark):
    assert rules(spark).risk_score == 0.0
    r = rules(spark, amount_rial=600_000_000, is_night=True, ip_unique_cards_1h=4, acc_fail_ratio_1h=0.5)
    assert r.risk_score > 0.5 and r.should_block
    r = rules(spark, amount_rial=600_000_000, is_night=True, acc_total_amount_24h=3_000_000_000,
              acc_small_tx_count_24h=9, ip_unique_cards_1h=9, dev_unique_cards_1h=9, acc_fail_ratio_1h=0.9,
              card_unique_accounts_24h=9)
    assert r.risk_score <= 1.0
    assert r.alerts[0].message.startswith("مبلغ تراکنش 600,000,000 ریال")


def test_decision_levels_and_top_alerts(spark):
    df = spark.createDataFrame([("T", "A", 1.0, True, None)],
                               "transaction_id string, account_number string, risk_score double, "
                               "should_block boolean, x string")
    alerts = F.array(*[F.struct(F.lit(c).alias("rule_code"), F.lit(s).alias("severity"), F.lit(c).alias("message"))
                       for c, s in [("L1", "low"), ("H1", "high"), ("M1", "medium")] * 4])
    d = decide(df.withColumn("alerts", alerts)).first()
    assert d.risk_score == 0.6 and d.risk_level == "high" and d.should_block and d.ml_score == 0.0
    assert [a.code for a in d.top_alerts] == ["H1", "H1", "H1", "H1", "M1"]
    assert d.alert_count == 12 and d.decided_at.endswith("Z")
    low = decide(df.withColumn("risk_score", F.lit(0.1)).withColumn("should_block", F.lit(False))
                 .withColumn("alerts", F.array().cast("array<struct<rule_code:string,severity:string,message:string>>"))).first()
    assert low.risk_level == "low" and not low.should_block
