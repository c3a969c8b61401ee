"""Importance resampling against plain Python."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import importance, position_crc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_crc_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 2_500_000).astype(np.uint8)
    for size in (0, 1, 63, 64, 65, 128, 1000, 1 << 20, (1 << 20) + 1, 2_400_007):
        assert position_crc.long_span(data[:size]) == zlib.crc32(data[:size].tobytes())
    sizes = np.concatenate([rng.integers(0, 300, 4000), [0, 64, 65, 64 * 64, 64 * 64 + 1, 64 * 64 + 64, 1 << 21]])
    start = rng.integers(0, 400_000, len(sizes))
    got = position_crc.of_spans(data, start, start + sizes)
    assert [int(g) for g in got] == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, sizes)]
    assert len(position_crc.of_spans(data, start[:0], start[:0])) == 0


def grams(text, longest):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [[zlib.crc32(" ".join(w[i:i + n]).encode()) for i in range(len(w) - n + 1)] for n in range(1, longest + 1)]


@pytest.mark.parametrize("piece", [5, 40, 1 << 20])
@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_at_every_cut(monkeypatch, piece, longest):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(piece * 10 + longest)
    texts = ["".join(rng.choice("aBZz9 é.-\n漢  x\x00") for _ in range(rng.randint(0, 70))) for _ in range(50)]
    texts += ["", "  ", "a" * 300 + " " + "b" * 65, "\x7f", "Ünter ÄB"]
    got = [[[] for _ in range(longest)] for _ in texts]
    for n, bucket, owner in importance.features([t.encode() for t in texts], longest, 10007):
        for b, o in zip(bucket.tolist(), owner.tolist()):
            got[o][n - 1].append(b)
    for text, own in zip(texts, got):
        assert own == [[c % 10007 for c in each] for each in grams(text, longest)]


def brute(docs, target, longest, buckets, least, percent, seed):
    own = [[c % buckets for each in grams(t, longest) for c in each] for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for counts, lists in ((s, own), (t, [[c % buckets for each in grams(x, longest) for c in each] for x in target])):
        for buckets_of in lists:
            for b in buckets_of:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for i, ((key, text), mine) in enumerate(zip(docs, own)):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in mine)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(mine), weight, score, None])
        if len(grams(text, 1)[0]) >= least:
            able.append(i)
    able.sort(key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][2], rows[i][1]))
    for rank, i in enumerate(able[:percent * len(able) // 100]):
        rows[i][4] = rank + 1
    return rows


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 40)])
def test_resample_equals_brute_force(spark, longest, percent):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "gämma", "x1", "delta", "eps-ilon", "漢字" * 30, "of", "THE"]
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)]
    docs += [(7, docs[7][1] + text(25))] * 100  # one key on a third of the rows, ties among them
    docs += [(None, text(30)), (None, None), (900, None), (901, ""), (902, "word " * 60_000)]
    target = [text(12) + " beta beta" for _ in range(15)] + [None, ""]
    schema = "doc_id bigint, text string, rank int, row string, key string, weight double"
    df = spark.createDataFrame([(k, t, 1, "r", "k", 0.5) for k, t in docs], schema).repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "goal string")
    got = importance.resample(df, goal, target_text="goal", longest=longest, buckets=97, least_words=9, percent=percent, seed=5).collect()
    want = brute(docs, target, longest, 97, 9, percent, 5)
    def order(r):
        return [(x is None, x or 0) for x in r]
    assert sorted(([r.row.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in got), key=order) == sorted(want, key=order)
    assert got[0].row.asDict().keys() == {"doc_id", "rank", "row", "key", "weight"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "b c " * 20)], "doc_id bigint, text string")
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none, least_words=1, percent=100)
    assert sorted((r.row.doc_id, r["rank"] is not None) for r in got.collect()) == [(1, True), (2, True)]
    assert importance.resample(none, none).count() == 0


def test_ranks_are_whole(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    got = importance.resample(df, df.limit(5), least_words=3, percent=50).where("rank is not null")
    ranks = [(r["rank"], -r.score, r.row.doc_id) for r in got.collect()]
    assert [r[0] for r in sorted(ranks)] == list(range(1, 1501)) and sorted(ranks) == sorted(ranks, key=lambda r: r[1:])
