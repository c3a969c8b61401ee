"""Graph fixture, ML shapes and ranges, ordered operators."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph as G
from ledgerlens.operators import ml as ML
from ledgerlens.operators.ordered import key_rank

TX_SCHEMA = ("transaction_id string, timestamp_utc string, amount_rial long, card_pan string, "
             "account_number string, national_code string, mobile_normalized string, ip_address string, "
             "device_fp_hash string, ip_confidence double")


@pytest.fixture(scope="module")
def gtx(spark):
    rows = [("P-1", "2025-03-02T05:45:30Z", 730000, "5022291111111118", "S-10", "0499370899",
             "09351234567", "91.98.4.7", "dv-hash", 1.0),
            ("P-2", "2025-03-02T05:45:30Z", 730000, "5022291111111118", "S-10", "0499370899",
             "09351234567", "10.20.0.9", "dv-hash", 0.3)]
    return spark.createDataFrame(rows, TX_SCHEMA).withColumn("event_time", F.to_timestamp("timestamp_utc"))


def test_nodes_and_edges(gtx):
    nodes, edges = G.ingest_batch(None, None, gtx)
    labels = {r.label for r in nodes.collect()}
    assert labels == {"Person", "Card", "Account", "Mobile", "IP", "Device", "NationalCode"}
    e = edges.collect()
    assert {r.rel_type for r in e} == {"OWNS_CARD", "OWNS_ACCOUNT", "HAS_MOBILE", "USES_IP", "USES_DEVICE",
                                       "IDENTIFIED_BY"}
    ip = {r.to_id: r.confidence for r in e if r.rel_type == "USES_IP"}
    assert ip == {"91.98.4.7": 1.0, "10.20.0.9": 0.3}


def test_merge_adds_amounts_once(gtx):
    n1, e1 = G.ingest_batch(None, None, gtx, person_key="national_code")
    n2, e2 = G.ingest_batch(n1, e1, gtx, person_key="national_code")
    card = [r for r in e2.collect() if r.rel_type == "OWNS_CARD"][0]
    assert card.tx_count == 4 and card.total_amount == 2920000
    assert n2.count() == n1.count()


def test_empty_delta_is_noop(spark, gtx):
    n1, _ = G.ingest_batch(None, None, gtx)
    empty = n1.limit(0)
    assert G.merge_nodes(n1, empty).count() == n1.count()


def test_subgraph_unknown_person(spark, gtx):
    nodes, edges = G.ingest_batch(None, None, gtx)
    seeds = spark.createDataFrame([("nobody",), ("P-1_person",)], "person_id string")
    sg = G.identity_subgraph(nodes, edges, seeds).collect()
    assert [r.person_id for r in sg] == ["P-1_person"] and len(sg[0].entities) == 6


def test_shared_entities_confidence_and_limit(spark, gtx):
    _, edges = G.ingest_batch(None, None, gtx)
    s = G.shared_entities(edges).collect()
    # the NAT IP edge (0.3) never links persons; the other five entities do
    assert all(r.entity_type != "IP" for r in s)
    assert len([r for r in s if r.person_id == "P-1_person"]) == 5


def test_shared_entities_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", "Device", f"d{int(rng.integers(0, 3))}", float(rng.choice([0.3, 1.0])), "USES_DEVICE")
            for i in range(300)]
    edges = spark.createDataFrame(rows, "from_id string, to_label string, to_id string, confidence double, "
                                        "rel_type string")
    got = {(r.person_id, r.related_person) for r in G.shared_entities(edges, limit=7).collect()}
    e = [r for r in rows if r[3] >= 0.5]
    want = set()
    for p, _, d, c, _ in e:
        cand = sorted([(-c2, q) for q, _, d2, c2, _ in e if d2 == d and q != p])[:7]
        want |= {(p, q) for _, q in cand}
    assert got == want


def test_key_rank_matches_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", ["hot", "a", "b"][int(rng.integers(0, 3))] if i % 4 else "hot",
             int(rng.integers(0, 5_000))) for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_id string, k string, s long").withColumn(
        "event_time", F.timestamp_seconds("s"))
    got = {r.transaction_id: r.seq_rank for r in key_rank(df, "k", chunk_seconds=300).collect()}
    from pyspark.sql.window import Window
    w = Window.partitionBy("k").orderBy("event_time", "transaction_id")
    want = {r.transaction_id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(240):
        rows.append((f"TX-{i:04d}", f"u{i % 6}", int(rng.integers(1_000, 10**9)), bool(rng.random() < 0.3),
                     float(rng.choice([0.3, 1.0])), bool(rng.random() < 0.2), int(1_704_067_200 + i * 977),
                     "FAILED" if rng.random() < 0.3 else "SUCCESS", f"185.1.1.{i % 3}", f"fp-{i % 4}"))
    df = spark.createDataFrame(rows, "transaction_id string, national_code string, amount_rial long, "
                                     "is_night boolean, ip_confidence double, is_carrier_nat boolean, s long, "
                                     "result string, ip_address string, device_fp_hash string")
    return df.withColumn("event_time", F.timestamp_seconds("s"))


def test_sequences_shape(seqs):
    s = ML.sequences(seqs, "national_code", n=20).collect()
    assert len(s) == 240 and all(len(r.seq) == 160 for r in s)
    assert max(r.seq_len for r in s) == 20 and min(r.seq_len for r in s) == 1


def test_models_ranges(seqs):
    s = ML.sequences(seqs, "national_code").withColumn("label", (F.col("result") == "FAILED").cast("double"))
    m = ML.fit_sequence_classifier(s, max_iter=5)
    p = [r.lstm_score for r in ML.sequence_probability(m, s).collect()]
    assert len(p) == 240 and all(0 <= x <= 1 for x in p)
    rec = ML.fit_reconstruction(s, k=4)
    with pytest.raises(ValueError):
        rec.anomaly(s)
    assert rec.fit_threshold(s) >= 0
    a = rec.anomaly(s).collect()
    assert all(0 <= r.ae_score <= 1 for r in a)


def test_profiles(seqs):
    b = ML.behavioral_30d(seqs, "national_code")
    prof = ML.fit_profiles(b, starts=2)
    out = prof.profile(b).collect()
    assert all(0 <= r.cluster < 5 and r.distance >= 0 and 0 <= r.behavioral_score <= 1 for r in out)


def test_combine(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, None, None), (1.0, 1.0, 1.0), (0.2, 0.4, None)],
                               "lstm_score double, ae_score double, behavioral_score double")
    got = [r.ml_score for r in ML.combine_scores(df).collect()]
    assert got == [0.0, 1.0, 1.0, round((0.2 * 0.5 + 0.4 * 0.3) / 0.8, 4)]


@pytest.mark.parametrize("chunk,span", [(90, 3), (300, 288), (1, 2)])
def test_timeline_matches_range_frames(spark, monkeypatch, chunk, span):
    from pyspark.sql.window import Window
    from ledgerlens.operators import timeline as TL
    monkeypatch.setattr(TL, "CHUNK_SECONDS", chunk)
    monkeypatch.setattr(TL, "SPAN_CHUNKS", span)
    rng = np.random.default_rng(5)
    keys = ["hot", "hot", "a", "b", None]
    rows = [(f"t{i}", keys[int(rng.integers(0, 5))], int(rng.integers(0, 9000)), int(rng.integers(1, 100)),
             [f"v{int(rng.integers(0, 6))}", None][int(rng.integers(0, 5)) == 0]) for i in range(700)]
    rows += [("t1", "a", 4000, 7, "v1"), ("t1", "a", 4000, 7, "v1"), ("t1", "a", 4000, 9, "v9"), (None, None, 4600, 1, None)]
    df = spark.createDataFrame(rows, "transaction_id string, k string, s long, x long, v string").withColumn(
        "event_time", F.timestamp_seconds("s"))
    trails = [TL.Trail(600, {"sx": "x", "n": "one"}, {"dv": "v"}, first="f"), TL.Trail(60, {"sy": "x"}, {"dw": "v"}),
              TL.Trail(4000, {}, {"dz": "v"}, first="g")]
    got = TL.trailing(df, "k", trails, {"x": F.col("x"), "one": F.lit(1).cast("bigint")})
    t = F.unix_micros("event_time")

    def frame(seconds):
        return Window.partitionBy("k").orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    w = frame(600)
    want = df.withColumns({"sx": F.sum("x").over(w), "n": F.count(F.lit(1)).over(w), "dv": F.size(F.collect_set("v").over(w)).cast("long"),
                           "f": F.min(t).over(w), "sy": F.sum("x").over(frame(60)), "dw": F.size(F.collect_set("v").over(frame(60))).cast("long"),
                           "dz": F.size(F.collect_set("v").over(frame(4000))).cast("long"), "g": F.min(t).over(frame(4000))})
    assert got.columns == df.columns + ["sx", "n", "dv", "f", "sy", "dw", "dz", "g"] and got.count() == len(rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_timeline_scans_and_repeated_ids(spark, tmp_path):
    from ledgerlens.operators.enrich import attach_features
    rows = [("T", "c1", "a1", "i1", "d1", 5, "FAILED"), ("T", "c2", "a1", "i1", "d1", 7, "SUCCESS"), ("T", "c2", "a1", "i1", "d1", 7, "SUCCESS")]
    tx = spark.createDataFrame(rows, "transaction_id string, card_pan string, account_number string, ip_address string, "
                               "device_fp_hash string, amount_rial long, result string").withColumn("event_time", F.timestamp_seconds(F.lit(10)))
    tx.write.parquet(f"{tmp_path}/tx")
    got = attach_features(spark.read.parquet(f"{tmp_path}/tx"), "trailing")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 1 + 4 * 4  # the rows, and at most four a timeline
    assert [(r.acc_total_amount_24h, r.ip_unique_cards_1h, r.card_unique_accounts_24h, round(r.acc_fail_ratio_1h, 3))
            for r in got.collect()] == [(19, 2, 1, 0.333)] * 3


def test_timeline_writes_few_events_once(spark):
    """Of 200 occurrences of a value within a chunk only the ends of the run become
    events, and the points are computed once however often the events are read."""
    from ledgerlens.operators import timeline as TL
    df = spark.range(200).select(F.lit("k").alias("k"), F.lit("v").alias("v"), F.timestamp_seconds("id").alias("event_time"))
    kept = []

    def keep(events):
        kept.append(events.localCheckpoint())
        return kept[-1]
    swept = TL.sweep(TL.points(df, "k", {"n": F.lit(1)}), {"v": TL.occurrences(df, "k", "v")}, [TL.Trail(600, {"s": "n"}, {"d": "v"})], keep=keep)
    assert sorted((r.s, r.d) for r in swept.collect()) == [(i + 1, 1) for i in range(200)]
    assert len(kept) == 1 and kept[0].where("d <> 0").count() == 2


def test_last_n_copies_few_rows_as_halo(spark):
    from ledgerlens.operators.ordered import last_n
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).otherwise("k").alias("k"), "id")
    from pyspark.sql.window import Window
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long"))
    got = last_n(df, "k", F.col("id"), 4, rank="r", extra={"prev": F.lag("id")}).collect()
    for none in (True, False):
        rows = sorted((r for r in got if (r.k is None) == none), key=lambda r: r.r)
        ids = [i for i in range(1000) if (i % 3 == 0) == none]
        assert [r._items for r in rows] == [ids[max(0, j - 3):j + 1] for j in range(len(ids))]
        assert [r.prev for r in rows] == [None, *ids[:-1]]
    union = last_n(df, "k", F.col("id"), 4, rank="r")
    assert union.count() == 1000 and "% 40" in union._jdf.queryExecution().optimizedPlan().toString()  # the halo is a part of the rows


def test_sequences_are_computed_once_for_fits_and_scores(spark):
    """The plan that scores starts from the written sequences, not from the windows that made them."""
    from ledgerlens.plans import q_ml as Q
    plan = Q._labelled_sequences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Relation" in plan
