"""Ingestion fixtures (validation, normalisation, dead letters)."""
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ingest as IN
from ledgerlens.sources.raw_json import unwrap

BASE = {"transaction_id": "P-501", "timestamp": "2025-03-02T09:15:30", "amount_rial": 730000,
        "card_pan": "5022291111111118", "account_number": "77001", "national_code": "0499370899",
        "mobile": "09351234567", "ip_address": "91.98.4.7", "device_fingerprint": "dv-1",
        "channel": "POS", "result": "SUCCESS"}


def run(spark, *records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "payload string")
    v = IN.validate(IN.parse_payloads(df))
    clean, dlq = IN.split(v)
    return clean.collect(), dlq.collect(), IN.ingest_stats(v).first()


def rec(**kw):
    r = dict(BASE)
    r.update(kw)
    return r


def test_valid_record(spark):
    clean, dlq, stats = run(spark, rec())
    assert len(clean) == 1 and not dlq
    c = clean[0]
    assert c.timestamp_utc == "2025-03-02T05:45:30Z"
    assert c.timestamp_local == "2025-03-02T09:15:30+0330"
    assert c.mobile_e164 == "+989351234567" and c.mobile_normalized == "09351234567"
    assert c.card_pan_masked == "502229xxxxxx1118"
    assert c.is_carrier_nat is False and c.ip_confidence == 1.0
    assert stats.ok == 1 and stats.dlq == 0


def test_rejections(spark):
    clean, dlq, stats = run(spark, rec(card_pan="4411"), rec(amount_rial=-7), rec(ip_address="300.1.2.3"),
                            rec(national_code="1111111111"), rec(national_code="0499370898"),
                            rec(timestamp="yesterday"), rec(device_fingerprint="   "))
    assert not clean and len(dlq) == 7 and stats.dlq == 7
    errs = sorted(d.error for d in dlq)
    assert any("card_pan" in e and e.startswith("ValidationError") for e in errs)
    assert any("UnexpectedError" in e for e in errs)
    assert any("device_fingerprint" in e for e in errs)
    assert all(d.source == "bank_api" for d in dlq)


def test_multiple_field_errors_joined(spark):
    _, dlq, _ = run(spark, rec(card_pan="1", amount_rial=-5))
    assert dlq[0].error.count("; ") == 1


def test_accepted_codes_and_digits(spark):
    clean, dlq, _ = run(spark, rec(national_code="1234567891"), rec(national_code="0084575948"),
                        rec(card_pan="5022-2911-1111-1118"), rec(card_pan="۵۰۲۲۲۹۱۱۱۱۱۱۱۱۱۸"))
    assert len(clean) == 4 and not dlq
    assert {c.card_pan for c in clean} == {"5022291111111118"}


def test_mobile_forms(spark):
    clean, _, _ = run(spark, rec(mobile="989351234567"), rec(mobile="9351234567"))
    assert {(c.mobile_e164, c.mobile_normalized) for c in clean} == {("+989351234567", "09351234567")}


def test_night_flag_and_nat(spark):
    clean, _, _ = run(spark, rec(transaction_id="a", timestamp="2025-03-02T23:40:00"),
                      rec(transaction_id="b", timestamp="2025-03-02T11:20:00", ip_address="172.20.3.4"),
                      rec(transaction_id="c", ip_address="10.8.0.2"))
    by = {c.transaction_id: c for c in clean}
    assert by["a"].is_night is True and by["b"].is_night is False
    assert by["b"].is_carrier_nat and by["b"].ip_confidence == 0.3 and by["c"].is_carrier_nat


def test_envelopes(spark):
    bodies = [json.dumps([BASE, BASE]), json.dumps({"data": [BASE]}), json.dumps(BASE),
              json.dumps({"items": []})]
    df = spark.createDataFrame([(b,) for b in bodies], "value string")
    assert unwrap(df).count() == 4


def test_high_water_mark_never_moves_back(spark):
    clean, _, _ = run(spark, rec())
    df = spark.createDataFrame([(c.timestamp_utc,) for c in clean], "timestamp_utc string")
    assert IN.high_water_mark(df, since="2030-01-01T00:00:00Z").first()[0] == "2030-01-01T00:00:00Z"
    assert IN.high_water_mark(df).first()[0] == "2025-03-02T05:45:30Z"


def test_pages_lose_no_row_of_a_second(spark):
    rows = [(f"P-{i:03d}", f"2025-03-02T09:15:{i // 40:02d}Z") for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp_utc string")
    seen, cursor = [], None
    while page := IN.incremental(df, cursor, limit=15).collect():
        seen += [r.transaction_id for r in page]
        cursor = (page[-1].timestamp_utc, page[-1].transaction_id)
    assert seen == [t for t, _ in rows]
    assert IN.incremental(df).count() == 100


def test_pages_keep_rows_that_share_time_and_id(spark):
    rows = [(f"P-{i // 7:03d}", "2025-03-02T09:15:00Z", i) for i in range(60)] + [("P-000", "2025-03-02T09:15:01Z", 60 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp_utc string, n int")
    seen, cursor, sizes = [], None, []
    while page := IN.incremental(df, cursor, limit=15).collect():
        assert page == sorted(page, key=lambda r: (r.timestamp_utc, r.transaction_id))
        seen += [r.n for r in page]
        sizes.append(len(page))
        cursor = (page[-1].timestamp_utc, page[-1].transaction_id)
    assert sorted(seen) == list(range(100))
    assert sizes == [21, 21, 18, 40]  # a page ends with the rows that tie with its 15th
    assert IN.incremental(df, limit=15).columns == df.columns and IN.incremental(df.limit(0), limit=15).count() == 0


def test_iso_forms(spark):
    from datetime import datetime, timedelta

    from ledgerlens.functions import parse_event_time
    forms = ["20250608T223000", "2025-06-08T22", "20250608", "2025-W23-7", "2025W237T0815", "2025-W01", "2020-W53-5",
             "2025-06-08T22:30:00,25", "2025-06-08T22:30:00.123456789", "20250608T2230+0330", "2025-06-08T223005.5Z",
             "2025-06-08T22:30:00.5+03:30", "2025-06-08 22:30"]
    bad = ["2025-W54-1", "2025-W00-1", "2025-W53-1", "2025-W23-8", "20251308", "2025-06-08T2", "2025-06-08T22:3", "x"]
    df = spark.createDataFrame([(t,) for t in forms + bad], "t string")
    got = {r.t: r.u for r in df.select("t", parse_event_time(F.col("t")).cast("string").alias("u")).collect()}
    for t in forms:
        want = datetime.fromisoformat(t)
        want = want.replace(tzinfo=None) - (want.utcoffset() if want.tzinfo else timedelta(hours=3, minutes=30))
        assert datetime.fromisoformat(got[t]) == want, t
    assert all(got[t] is None for t in bad)
