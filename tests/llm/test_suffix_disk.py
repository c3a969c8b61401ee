"""What suffix_dedup leaves on disk, and its cells of many fragments."""
import os
import random
import time
import urllib.parse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import suffix_dedup
from ledgerlens.llm.common import scratch

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_steps_leave_little_on_disk(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    root = os.path.dirname(urllib.parse.urlparse(scratch(spark, "x")).path)
    tables, before = set(os.listdir(root)), shuffle_files(spark)
    setting = spark.conf.get(suffix_dedup.SHUFFLES_GO, None)
    found = suffix_dedup.dedup(docs)
    until = time.time() + 20

    def left():  # sums of one row a task stay
        return sum(n for f, n in shuffle_files(spark).items() if f not in before)

    while left() > 20_000 and time.time() < until:  # they go in the background
        time.sleep(0.5)
    assert left() < 20_000
    assert spark.conf.get(suffix_dedup.SHUFFLES_GO, None) == setting
    made = [os.path.join(d, f) for t in set(os.listdir(root)) - tables for d, _, fs in os.walk(os.path.join(root, t)) for f in fs]
    assert 0 < sum(map(os.path.getsize, made)) < 0.7 * text
    assert found.count() == docs.count()


def test_a_block_has_bounded_rows_of_fragments():
    assert suffix_dedup.cells_for(0) == 1 and suffix_dedup.cells_for(100 * suffix_dedup.FRAGMENTS) == 101
    many = 100_000 * suffix_dedup.FRAGMENTS
    assert many / suffix_dedup.cells_for(many) >= suffix_dedup.FRAGMENTS * suffix_dedup.CELL * 0.99


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        up = np.sort(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        wide = rng.integers(-1 << 63, (1 << 63) - 1, n)
        got = suffix_dedup.loose(suffix_dedup.tight(suffix_dedup.steps(up), wide, wide[:1]), np.uint32, np.int64, np.int64)
        assert np.array_equal(np.cumsum(got[0], dtype=np.uint32), up) and np.array_equal(got[1], wide) and np.array_equal(got[2], wide[:1])


def test_keys_are_dealt_evenly_and_in_order():
    least = np.random.default_rng(2).integers(0, 1 << 64, (27, 20_000), dtype=np.uint64).min(axis=0)
    keys = np.sort(suffix_dedup.spread(least))
    for n in (1, 7, 64):
        bucket, inside = suffix_dedup.bucket_of(keys, n), suffix_dedup.in_bucket(keys, n)
        assert bucket.tolist() == [int(k) * n >> 64 for k in keys] and inside.tolist() == [(int(k) * n >> 32) % (1 << 32) for k in keys]
        assert np.bincount(bucket.astype(int), minlength=n).max() < 1.3 * len(keys) / n


def test_a_cell_in_portions_answers_every_string(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FRAGMENTS", 8)
    rng, length = random.Random(4), 50
    lines = ["".join(rng.choice("abc \n") for _ in range(90)) for _ in range(6)]
    blocks = []
    for b in range(4):
        own = {}
        for _ in range(60):
            line, a = rng.choice(lines), rng.randint(0, 30)
            own.setdefault(line[a:a + rng.choice([50, 50, 55, 60])].encode(), rng.choice([3, 5, 9, None]))
        blocks.append([(t, suffix_dedup.LAST if d is None else d) for t, d in own.items()])
    holders = {}
    for t, d in (x for own in blocks for x in own):
        for i in range(len(t) - length + 1):
            holders.setdefault((suffix_key(t, length), t[i:i + length]), set()).add(d)
    packed = [suffix_dedup.tight(np.array([len(t) for t, _ in own], np.uint8), np.array([d for _, d in own], np.int64),
                                 np.frombuffer(b"".join(t for t, _ in own), np.uint8)) for own in blocks]
    rows = pa.table({"block": pa.array(range(4), pa.int64()), "cell": pa.array([0] * 4, pa.int64()),
                     "n": pa.array([len(o) for o in blocks], pa.int32()), "body": pa.array(packed, pa.binary())})
    got = suffix_dedup.answers(length)((pa.scalar(0),), rows)
    for own, n, body in zip(blocks, got.column("n").to_pylist(), got.column("body").to_pylist()):
        want = [min(holders[suffix_key(t, length), t[i:i + length]]) < d for t, d in own for i in range(len(t) - length + 1)]
        assert np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little", count=n).tolist() == want
    assert suffix_dedup.answers(length)((pa.scalar(-3),), rows) is rows


def suffix_key(text, length):
    """Fragments are compared with those of their minimizer."""
    raw = np.frombuffer(text, np.uint8)
    return int(suffix_dedup.minimizers(raw, np.array([len(raw)]), length)[0])
