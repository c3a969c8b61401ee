"""Quality classifier: features and updates against plain Python, held-out
accuracy, and the cases of the docstring."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import q_text, quality

M = 0xFFFFFFFF


def mix(h, salt):
    h = (h ^ salt) * 0x9E3779B1 & M
    return (h ^ (h >> 15)) * 0x85EBCA77 & M


def features(text):
    """Places and values of a text, word by word."""
    raw, items = text.encode(), []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", raw):
        run = m.group()
        for i in range(0, len(run), 64):
            w = run[i:i + 64]
            h = zlib.crc32(re.sub(rb"[A-Z]", lambda x: x.group().lower(), w))
            signs = not re.match(rb"[0-9A-Za-z\x80-\xff]", w)
            shape = mix(h, 7) if signs else bool(re.search(rb"[A-Z]", w)) + 2 * bool(re.search(rb"[a-z]", w)) + 4 * bool(re.search(rb"[0-9]", w))
            items.append((h, shape))
    words = [h for h, _ in items]
    shapes = [0x5A17 if i and words[i] == words[i - 1] else s for i, (_, s) in enumerate(items)]
    found = Counter()
    for salt, (source, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        for i in range(len(source) - n + 1):
            g = salt + 1
            for x in source[i:i + n]:
                g = (mix(g, salt) + x) & M
            found[mix(g, salt) >> (32 - quality.BITS)] += 1
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in found.values()))
    return {p: math.log1p(c) / norm for p, c in sorted(found.items())}


@pytest.mark.parametrize("piece", [9, 70, 1 << 20])
def test_features_by_definition(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    rng = random.Random(piece)
    texts = [" ".join("".join(rng.choice("aB9é.-|$\n") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += ["", " \t\n", "The The The The", "one", "A | b | c", "ÉÉÉ $$$ !!"]
    if piece > 300:
        texts.append("x" * 150 + " " + "-" * 130)
    text, at, value = quality.vectors([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = text == i
        want = features(t)
        assert at[own].tolist() == list(want)
        assert np.allclose(value[own], list(want.values()))


def test_a_long_text_has_the_features_of_the_whole():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "Beta,", "x1", "|", "the the"]) for _ in range(600_000))
    assert len(long) > 2 * quality.PIECE
    _, at, value = quality.vectors([b"short", long.encode()])
    want = features(long)
    assert at[-len(want):].tolist() == list(want) and np.allclose(value[-len(want):], list(want.values()))


def follow(state, rows):
    """Plain updates of a state {place: (z, n)}, row by row."""
    state = dict(state)
    for at, label in rows:
        at = {**at, "bias": 1.0}
        w = {}
        for p in at:
            z, n = state.get(p, (0.0, 0.0))
            w[p] = 0.0 if abs(z) <= quality.L1 else (math.copysign(quality.L1, z) - z) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)
        p1 = 1 / (1 + math.exp(-sum(w[p] * x for p, x in at.items())))
        for p, x in at.items():
            z, n = state.get(p, (0.0, 0.0))
            g = (p1 - label) * x
            state[p] = (z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / quality.ALPHA * w[p], n + g * g)
    return state


def table(spark, n=80):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        body = " ".join(rng.choice(["river", "stone", "Light", "seven", "walks", "42"]) + ("" if good else " |") for _ in range(rng.randint(1, 12)))
        rows.append((i, body, int(good)))
    docs = spark.createDataFrame([(k, t, 9.5) for k, t, _ in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    return rows, docs, labels


def test_fit_equals_plain_updates(spark):
    rows, docs, labels = table(spark)
    model = quality.fit(docs, labels)
    keys = spark.createDataFrame([(k,) for k, _, _ in rows], "k bigint").select(
        "k", F.xxhash64("k").alias("h"), F.pmod(F.xxhash64("k"), F.lit(quality.SHARDS)).alias("s")).collect()
    by = {k: (features(t), y) for k, t, y in rows}
    state = {}
    for _ in range(quality.EPOCHS):
        moved = [follow(state, [by[r.k] for r in sorted(keys, key=lambda r: r.h) if r.s == s]) for s in range(quality.SHARDS)]
        places = {p for m in moved for p in m}
        new = {}
        for p in places:
            z, n = state.get(p, (0.0, 0.0))
            own = [m[p] for m in moved if p in m and m[p] != (z, n)]
            new[p] = (z + sum(a - z for a, _ in own) / max(1, len(own)), n + sum(b - n for _, b in own) / max(1, len(own)))
        state = new
    want = np.zeros((1 << quality.BITS) + 1)
    for p, (z, n) in state.items():
        want[-1 if p == "bias" else p] = quality.weights(np.array([z]), np.array([n]))[0]
    assert np.allclose(model.weight, want, atol=1e-9)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for k, t, _ in rows:
        dot = want[-1] + sum(want[p] * v for p, v in features(t).items())
        assert abs(got[k] - 1 / (1 + math.exp(-dot))) < 1e-9


def test_cases(spark):
    rows, docs, labels = table(spark)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, " \n", 3.0), (3, "stone " * 300_000, 4.0)], docs.schema)
    got = quality.score(odd, model).collect()
    start = 1 / (1 + math.exp(-model.weight[-1]))
    assert [abs(r.score - start) < 1e-12 for r in got] == [True] * 4 + [False] and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.limit(0), model).collect() == []
    extra = labels.unionAll(spark.createDataFrame([(None, 1), (5, None), (7, 0)], labels.schema))
    again = docs.unionAll(docs.where("doc_id = 7")).unionAll(spark.createDataFrame([(None, "x", 0.0)], docs.schema))
    assert np.array_equal(quality.fit(again, extra).weight, model.weight)
    for own, share in ((labels.limit(0), 0.0), (labels.where("quality = 0"), 0.0), (labels.where("quality = 1"), 1.0)):
        assert {round(r.score, 9) for r in quality.score(docs, quality.fit(docs, own)).collect()} == {share}


def test_bounded_rows(spark, monkeypatch):
    _, docs, labels = table(spark)
    model = quality.fit(docs, labels, max_rows=10)
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(10)
    assert np.array_equal(model.weight, quality.fit(docs, few).weight)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q_text.op13_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for k, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    above = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97 and sum(s >= 0.7 for s in good) > 0.97 * len(good)
