"""Merge logs: tiers, touched buckets, replays; the graph and account tables in them."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph as G
from ledgerlens.operators import monitor as M
from ledgerlens.streaming import maintained as MT
from ledgerlens.streaming import pipelines as S
from ledgerlens.streaming.merge_log import MergeLog, Table, due, newest, oldest

KV = {"t": Table("k string, first long, last long, n long", ("k",),
                 lambda: {"first": oldest("first"), "last": newest("last"), "n": F.sum("n")})}


def test_due_merges_by_tier():
    assert due([], 4) == (0, 0) and due([0, 0, 0], 4)[0] == 0
    assert due([0, 0, 0, 0], 4) == (4, 1)
    assert due([1, 1, 1, 0, 0, 0, 0], 4) == (7, 2)  # the merged one completes the next level
    assert due([2, 1, 0, 0, 0, 0], 4) == (4, 1)
    assert due([1, 1, 1, 1, 0], 4)[0] == 0


def kv(spark, rows):
    return spark.createDataFrame(rows, "k string, first long, last long, n long")


def test_log_equals_a_dictionary(spark, tmp_path):
    rng = np.random.default_rng(5)
    log = MergeLog(spark, str(tmp_path), KV, buckets=4, fan=2)
    assert log.read("t").count() == 0
    want, rewritten, segments = {}, {}, []
    for batch in range(7):
        keys = sorted({f"k{i}" for i in rng.integers(0, 12, 5)} | {None}, key=str) if batch != 3 else []
        rows = [(k, None if batch == 1 else batch, None if batch == 2 else batch, batch + 1) for k in keys]
        for k, first, last, n in rows:
            f, l, total = want.get(k, (None, None, 0))
            want[k] = (first if f is None else f, l if last is None else last, total + n)
        for _ in range(2 if batch in (2, 4) else 1):  # replayed after its commit
            log.append(batch, {"t": kv(spark, rows)})
            assert {r.k: (r.first, r.last, r.n) for r in log.read("t").collect()} == want
        segments.append(max(len(s) for s in log.manifest(batch)["t"].values()))
        assert log.batches() == [b for b in (batch - 1, batch) if b >= 0]
    assert max(segments) <= 3  # one a level at most after merging
    live = {name for b in (5, 6) for s in log.manifest(b)["t"].values() for name, _ in s}
    assert set(os.listdir(f"{tmp_path}/t")) == live  # nothing else is left
    assert {r.k: (r.first, r.last, r.n) for r in log.read("t", 5).collect()} != want  # the batch before stays readable


def test_a_foreign_or_lost_folder_is_refused(spark, tmp_path):
    log = MergeLog(spark, f"{tmp_path}/log", KV, buckets=4)
    with pytest.raises(FileNotFoundError):
        log.append(3, {"t": kv(spark, [])})
    log.append(0, {"t": kv(spark, [("a", 1, 1, 1)])})
    log.append(1, {"t": kv(spark, [])})
    with pytest.raises(FileExistsError):
        log.append(0, {"t": kv(spark, [])})
    with pytest.raises(ValueError):
        MergeLog(spark, f"{tmp_path}/log", KV, buckets=8).read("t")


def transactions(spark, lo, hi):
    rows = [(f"T{i:04d}", f"2025-03-02T{i // 60 % 24:02d}:{i % 60:02d}:00Z", 1000 + i, f"C{i % 7}", f"S-{i % 5}", f"N{i % 9}",
             f"M{i % 11}", None if i % 13 == 0 else f"10.0.0.{i % 4}", f"D{i % 3}", 0.3 if i % 2 else 1.0) for i in range(lo, hi)]
    schema = ("transaction_id string, timestamp_utc string, amount_rial long, card_pan string, account_number string, "
              "national_code string, mobile_normalized string, ip_address string, device_fp_hash string, ip_confidence double")
    return spark.createDataFrame(rows, schema).withColumn("event_time", F.to_timestamp("timestamp_utc"))


def as_set(df):
    return sorted(map(repr, df.collect()))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_graph_batches_equal_one_merge_and_touch_only_their_buckets(spark, tmp_path):
    log = MT.graph_log(spark, str(tmp_path), buckets=32)
    nodes = edges = None
    for b, (lo, hi) in enumerate([(0, 200), (200, 330), (330, 330), (330, 331), (331, 420)]):
        tx = transactions(spark, lo, hi)
        before, old = files(tmp_path), log.manifest(b - 1) if b else None
        MT.upkeep_batch(log, b, tx, "national_code")
        if hi - lo == 1:  # one transaction: six edges
            new = log.manifest(b)
            changed = [k for k in new["edges"] if new["edges"][k] != old["edges"].get(k)]
            assert 1 <= len(changed) <= 6 < len(new["edges"])
            written = {f for f, t in files(tmp_path).items() if before.get(f) != t}
            assert {f.split("bucket=")[1].split("/")[0] for f in written if "/edges/" in f} == set(changed)
        nodes, edges = G.ingest_batch(nodes, edges, tx, "national_code")
        nodes, edges = [spark.createDataFrame(d.collect(), d.schema) for d in (nodes, edges)]
    MT.upkeep_batch(log, 4, transactions(spark, 331, 420), "national_code")  # replayed
    got_nodes, got_edges = MT.read_graph(log)
    assert as_set(got_nodes) == as_set(nodes) and as_set(got_edges) == as_set(edges)
    assert as_set(got_edges) == as_set(G.graph_edges(transactions(spark, 0, 420), "national_code"))


def test_killed_graph_upkeep_goes_on(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/source"
    for i in range(3):
        transactions(spark, 50 * i, 50 * i + 50).coalesce(1).write.parquet(f"{source}/part={i}")
        for f in os.listdir(f"{source}/part={i}"):
            os.utime(f"{source}/part={i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))

    def start():
        stream = spark.readStream.schema(transactions(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        return S.start_graph_upkeep(stream, f"{tmp_path}/graph", f"{tmp_path}/ckpt", "national_code", {"availableNow": True}, buckets=4)
    write, calls = MergeLog._write, []

    def dies(self, table, segment, rows):
        calls.append((table, segment))
        if len(calls) == 4:  # the edges of batch 1, after its nodes
            raise RuntimeError("lost")
        return write(self, table, segment, rows)
    monkeypatch.setattr(MergeLog, "_write", dies)
    with pytest.raises(Exception):
        start().awaitTermination()
    log = MT.graph_log(spark, f"{tmp_path}/graph", 4)
    assert log.batches() == [0]
    start().awaitTermination()
    assert log.batches() == [1, 2]
    assert as_set(MT.read_graph(log)[1]) == as_set(G.graph_edges(transactions(spark, 0, 150), "national_code"))


def test_account_tables_equal_the_batch_job(spark, tmp_path):
    rng = np.random.default_rng(8)
    schema = ("account_id string, transaction_id string, event_time timestamp, risk_level string, risk_score double, "
              "should_block boolean, top_alerts array<struct<code: string, severity: string, message: string>>")
    levels = ["low", "medium", "high", "critical"]
    rows = [([f"A{int(rng.integers(0, 6))}", "A0", None][int(rng.integers(0, 3))], f"T{i}", int(rng.integers(0, 50)),
             levels[int(rng.integers(0, 4))], float(rng.integers(0, 5)) / 4, bool(rng.integers(0, 5) == 0),
             [(f"R00{int(c)}", "high", "m") for c in rng.integers(1, 9, int(rng.integers(0, 3)))]) for i in range(160)]

    def frame(rs):
        raw = spark.createDataFrame(rs, schema.replace("event_time timestamp", "event_time long"))
        return raw.withColumn("event_time", F.timestamp_seconds("event_time"))
    log = MT.account_log(spark, str(tmp_path), buckets=4)
    for b, (lo, hi) in enumerate([(0, 40), (40, 41), (41, 41), (41, 90), (90, 160)]):
        MT.account_batch(log, b, frame(rows[lo:hi]))
        if b == 3:
            MT.account_batch(log, b, frame(rows[lo:hi]))
    whole = frame(rows)
    want = M.account_risk_status(whole)
    assert as_set(MT.account_risk_status(log).select(*want.columns)) == as_set(want)
    want = M.blocked_accounts(whole)
    assert as_set(MT.blocked_accounts(log).select(*want.columns)) == as_set(want)
