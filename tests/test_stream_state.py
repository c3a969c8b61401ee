"""Streaming scoring with history: state, replays, folds, restarts, late rows."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.decision import decide
from ledgerlens.operators.enrich import attach_features, attach_limits
from ledgerlens.operators.rules import evaluate_rules
from ledgerlens.streaming import pipelines as S
from ledgerlens.streaming import trail_state as TS
from ledgerlens.streaming.sinks import BatchSink, totals
from ledgerlens.streaming.state import BatchState

SCHEMA = ("transaction_id string, s double, card_pan string, account_number string, ip_address string, device_fp_hash string, "
          "amount_rial long, result string, is_night boolean, account_type string")


def rows(n, hours, seed):
    rng = np.random.default_rng(seed)
    return [(f"T{seed}-{i}", float(t), f"60379900000000{rng.integers(0, 9):02d}", [f"A{rng.integers(0, 3)}", "A0"][rng.integers(0, 2)],
             f"I{rng.integers(0, 3)}", [f"D{rng.integers(0, 4)}", None][int(rng.integers(0, 9) == 0)], int(rng.integers(1, 900)) * 1_000_000,
             ["FAILED", "SUCCESS"][rng.integers(0, 2)], bool(rng.integers(0, 2)), ["normal", "vip"][rng.integers(0, 2)])
            for i, t in enumerate(np.sort(rng.uniform(0, hours * 3600, n)).round(3))]


def frame(spark, rs):
    return spark.createDataFrame(rs, SCHEMA).withColumn("event_time", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def as_rows(decisions):
    return sorted(repr((r.transaction_id, r.risk_score, r.rule_score, r.alert_count, [(a.code, a.severity, a.message) for a in r.top_alerts]))
                  for r in decisions.collect())


def batch_job(spark, rs):
    return decide(evaluate_rules(attach_limits(attach_features(frame(spark, rs), "trailing"))))


def test_batches_equal_the_batch_job(spark, tmp_path):
    rs = rows(240, 70, 1)
    cuts = [0, 20, 70, 72, 160, 230, 240]  # hours within and beyond a window, a batch of two rows
    rs[71] = rs[71][:1] + (rs[71][1],) + rs[71][2:]
    state = BatchState(spark, f"{tmp_path}/state", TS.SCHEMAS, compact=2)
    sink = BatchSink(spark, f"{tmp_path}/decisions")
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        S.score_batch(frame(spark, rs[lo:hi]), b, state, sink)
        if b == 3:  # replayed after its commit and after the fold: nothing changes
            S.score_batch(frame(spark, rs[lo:hi]), b, state, sink)
    assert as_rows(sink.read()) == as_rows(batch_job(spark, rs))
    t = totals(sink, ["total_tx", "blocked", "late"]).first()
    assert (t.total_tx, t.late, t.batches) == (240, 0, 6) and t.blocked == batch_job(spark, rs).where("should_block").count()
    # late by 10 hours, at a time between others: features of all rows up to it
    late = rs[200][:1] + (rs[200][1] - 36_000.0,) + rs[200][2:]
    late = ("LATE", *late[1:])
    S.score_batch(frame(spark, [late]), 6, state, sink)
    want = batch_job(spark, rs + [late]).where("transaction_id = 'LATE'")
    assert as_rows(sink.read().where("transaction_id = 'LATE'")) == as_rows(want)
    # beyond the lateness: counted, and still decided
    S.score_batch(frame(spark, [("OLD", 5.0, *late[2:])]), 7, state, sink)
    t = totals(sink, ["total_tx", "late"]).first()
    assert (t.total_tx, t.late) == (242, 1)
    hours = state.read("point_hours", 8)
    newest = max(r[1] for r in rs)
    state.fold(7, TS.merges(int(newest * 1_000_000)))
    kept = [r.hour for r in state.read("point_hours", 8).collect()]
    assert kept and min(kept) >= newest * 1_000_000 - TS.HORIZON - (TS.LATENESS + 7200) * 1_000_000 and hours.columns
    with pytest.raises(FileExistsError):
        state.check(2)
    folders = os.listdir(f"{tmp_path}/state/data/points")
    assert len([f for f in folders if f.startswith("batch=")]) <= 4  # folded deltas are deleted


def test_a_killed_query_goes_on(spark, tmp_path, monkeypatch):
    rs = rows(90, 40, 2)
    source = f"{tmp_path}/source"
    for i in range(3):
        frame(spark, rs[30 * i:30 * i + 30]).coalesce(1).write.mode("append").parquet(source)
        names = sorted((f for f in os.listdir(source) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{source}/{f}"))
        os.utime(f"{source}/{names[-1]}", (1_700_000_000 + i, 1_700_000_000 + i))

    def start():
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        return S.start_scoring(stream, f"{tmp_path}/decisions", f"{tmp_path}/state", f"{tmp_path}/ckpt", trigger={"availableNow": True})

    commit, calls = BatchState.write, []

    def dies(self, batch, tables, meta):
        calls.append(batch)
        if calls == [0, 1]:  # after the decisions of batch 1, half its state written
            commit(self, batch, {"points": tables["points"]}, meta)
            self.files.delete(f"{self.folder}/commits/{batch:012d}.json")
            raise RuntimeError("executor lost")
        commit(self, batch, tables, meta)
    monkeypatch.setattr(BatchState, "write", dies)
    with pytest.raises(Exception):
        start().awaitTermination()
    assert calls == [0, 1]
    start().awaitTermination()
    sink = BatchSink(spark, f"{tmp_path}/decisions")
    assert calls == [0, 1, 1, 2] and sink.batches() == [0, 1, 2]
    assert as_rows(sink.read()) == as_rows(batch_job(spark, rs))
    assert totals(sink, ["total_tx"]).first() == (90, 3)
    start().awaitTermination()  # nothing new
    assert totals(sink, ["total_tx"]).first() == (90, 3)


def test_empty_batches_and_an_empty_sink(spark, tmp_path):
    state, sink = BatchState(spark, f"{tmp_path}/state", TS.SCHEMAS), BatchSink(spark, f"{tmp_path}/decisions")
    S.score_batch(frame(spark, []), 0, state, sink)
    assert sink.read().count() == 0 and totals(sink, ["total_tx"]).first() == (0, 1)
    with pytest.raises(FileNotFoundError):
        BatchSink(spark, f"{tmp_path}/none").read()
