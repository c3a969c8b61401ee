"""Every pipeline stage against brute force on its own input."""
import hashlib
import math
import os
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from ledgerlens.llm import q_text, toxicity
from ledgerlens.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
CLEAN = [9001, 9002, 9003]


def plain_score(model, text):
    """The n-grams one by one, over the whole text."""
    raw = b" " + text.encode().translate(toxicity.PLAIN) + b" "
    kept = {int(p): float(w) for p, w in zip(model.kept, model.weights)}
    seen = set()
    for n in toxicity.SIZES:
        for gram in {raw[i:i + n] for i in range(len(raw) - n + 1)}:
            h = 0
            for byte in gram:
                h = (h * 0x01000193 + byte) % 2**32
            seen.add(((h ^ h >> 15) * (0x9E3779B1 + 2 * n)) % 2**32 >> 32 - toxicity.BITS)
    return 1 / (1 + math.exp(-(model.intercept + sum(w for p, w in kept.items() if p in seen))))


def plain_fingerprint(text):
    w = [x for x in text.encode().lower().translate(bytes(32 if b in range(9, 14) else b for b in range(256))).split(b" ") if x]
    h = [xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def without_near_copies(rows):
    """One row of each group: that of the smallest id."""
    rows = list(dict.fromkeys(rows))
    fps = [plain_fingerprint(r.text or "") for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min((r for r, g in zip(rows, group) if g == x), key=lambda r: order(r.doc_id)) for x in set(group)]


def without_repeats(rows):
    """Texts without the characters whose bytes are all covered by 50-byte
    strings that start in a document with a smaller id."""
    docs, first, out = [(r.doc_id, (r.text or "").encode()) for r in rows], {}, []
    for d, body in sorted(docs, key=lambda x: order(x[0])):
        for i in range(len(body) - 49):
            first.setdefault(body[i:i + 50], d)
    for d, body in docs:
        end = 0
        gone = bytearray(len(body))
        for i in range(len(body) - 49):
            f = first[body[i:i + 50]]
            if f is not None and (d is None or f < d):
                lo, end = max(end, i), i + 50
                gone[lo:end] = b"\1" * (end - lo)
        at, kept = 0, []
        for c in body.decode():
            n = len(c.encode())
            if not all(gone[at:at + n]):
                kept.append(c)
            at += n
        out.append((d, "".join(kept)))
    return out


def words(text):
    plain = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text)
    return "".join(c.lower() if c.isascii() else c for c in plain).split(" ")


def contaminated(text, windows):
    w = [x for x in words(text) if x]
    return any(tuple(w[i:i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(11)
    real = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").orderBy("doc_id").limit(120)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 14").orderBy("item_id").first().text

    def text(n):
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage, body = text(60), text(300)
    long = text(60_000)  # over a span of the toxicity stage and many shingles
    assert len(long) > toxicity.SPAN + 1000
    planted = [(9001, text(80)), (9002, text(200) + " é ü 한"), (9003, text(5)), (9010, body), (9011, body), (9012, body + " tail"),
               (9020, f"{text(40)} {passage} {text(40)}"), (9021, f"{text(50)} {passage} {text(30)}"), (9030, f"{text(30)} {item} {text(30)}"),
               (9040, long), (9041, None), (9042, ""), (None, text(70)), (None, None)]
    more = spark.createDataFrame(planted, "doc_id bigint, text string")
    for c in real.columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit(None).cast(real.schema[c].dataType))
    docs = real.unionByName(more).unionByName(more.where("doc_id = 9001")).withColumn("score", F.lit("mine"))
    return corpus_pipeline.written(docs, "test")


def test_stages_equal_brute_force(spark, documents):
    stages, docs = dict(corpus_pipeline.STAGES), documents

    def step(name):
        out = corpus_pipeline.written(stages[name](spark, docs, SF), "test")
        return docs.collect(), out, out.collect()

    def same(got, want):
        assert sorted(map(repr, got)) == sorted(map(repr, want))

    model = q_text.toxicity_model(spark, docs, SF)
    before, out, after = step("toxicity")
    same(after, [r for r in before if plain_score(model, r.text or "") < 0.7])
    assert set(CLEAN) <= {r.doc_id for r in after} and len(after) < len(before)
    docs = out
    before, out, after = step("simhash_near_dedup")
    same(after, without_near_copies(before))
    assert {9010, *CLEAN} <= {r.doc_id for r in after} and 9011 not in {r.doc_id for r in after}
    assert len([r for r in after if r.doc_id == 9001]) == 1
    docs = out
    before, out, after = step("suffix_array_dedup")
    same([(r.doc_id, r.text) for r in after], without_repeats(before))
    assert all(r.n_chars == len(r.text) for r in after)
    kept = {r.doc_id: r.text for r in after}
    whole = {r.doc_id: r.text for r in before}
    assert len(kept[9021]) < len(whole[9021]) and all(kept[i] == whole[i] for i in [9020, 9040, *CLEAN])
    docs = out
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x for x in words(r.text or "") if x]
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(w[i:i + n]))
    before, out, after = step("benchmark_decontamination")
    same(after, [r for r in before if not contaminated(r.text or "", windows)])
    assert 9030 in {r.doc_id for r in before} - {r.doc_id for r in after} and set(CLEAN) <= {r.doc_id for r in after}
    docs = out
    before, out, after = step("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(q_text.PIECES))
    want = []
    for r in before:
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after], want)
