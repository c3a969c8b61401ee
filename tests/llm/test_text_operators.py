"""Text operators against the public libraries and brute force."""
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (decontaminate, q_text, sentencepiece_codec, simhash, suffix_dedup, token_count, token_files,
                            toxicity)
from ledgerlens.llm.common import scratch, vocabulary

SCRAPS = list("  \n\t\x00\x1c\x85\xa0 　aAbéßeE'stmvre019.,!?<>|İΣ") + [
    "▁", "한", "😀", "é", "<|endoftext|>", "<0x0A>", "<s>", "the", " the", "ing", "    "]


def scraps(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(SCRAPS, k=rng.randint(0, 40))) for _ in range(n)] + [
        "", " ", "a" * 4000, "ab " * 3000, " " * 300, "é한" * 1000]


def frame(spark, texts, **more):
    """Documents with a null text, a repeated row and further columns."""
    rows = [(i, t, "src0", "x") for i, t in enumerate(texts)] + [(len(texts), None, None, "x"), (0, texts[0], "src0", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids string")


def test_sentencepiece_equals_the_library():
    from sentencepiece import SentencePieceProcessor
    path = vocabulary(q_text.PIECES)
    lib, encode, decode = SentencePieceProcessor(model_file=path), sentencepiece_codec.Encoder(path), sentencepiece_codec.Decoder(path)
    texts = scraps(1500)
    for text, raw in zip(texts, encode(texts)):
        ids = np.frombuffer(raw, np.int32)
        assert ids.tolist() == lib.encode(text)
        assert decode(ids) == lib.decode(ids.tolist())
    rng = random.Random(5)
    for _ in range(1500):  # any ids, byte pieces that form no character among them
        ids = [rng.choice([0, 1, 2, 3, 130, 150, 197, 200, 259, 260, 28705, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert decode(np.array(ids, np.int32)) == lib.decode(ids)


def test_sentencepiece_frames(spark):
    path = vocabulary(q_text.PIECES)
    df = sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, scraps(50)), path), path)
    for r in df.collect():  # the clashing column ids is replaced
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert sentencepiece_codec.encode(df.limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    path = vocabulary(q_text.BYTES)
    lib, texts = Tokenizer.from_file(path), scraps(2500)
    count = token_count.Counter(path)
    assert count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = token_count.count_tokens(frame(spark, texts[:40]), path).collect()
    assert [r.n_tokens for r in rows if r.text is None] == [0]
    assert token_count.count_tokens(frame(spark, texts[:2]).limit(0), path).count() == 0


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer
    path = vocabulary(q_text.WORDS)
    lib, texts = Tokenizer.from_file(path), scraps(2500)
    for text, raw in zip(texts, token_files.Ids(path)(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_token_ids_of_every_letter_before_a_stop():
    from tokenizers import Tokenizer
    path = vocabulary(q_text.WORDS)
    lib, encode = Tokenizer.from_file(path), token_files.Ids(path)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    own = letters[::7] + [c for c in letters if unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFD", c) != c]
    texts = [f"{c}{stop} a{c}{stop}" for c, stop in zip(own, ".,;:!?" * len(own))]
    assert encode.apart
    wrong = [t for t, raw, enc in zip(texts, encode(texts), lib.encode_batch(texts, add_special_tokens=False))
             if np.frombuffer(raw, "<u4").tolist() != enc.ids]
    assert wrong == []


def test_token_ids_of_runs_of_marks():
    from tokenizers import Tokenizer
    path = vocabulary(q_text.WORDS)
    lib, encode, rng = Tokenizer.from_file(path), token_files.Ids(path), random.Random(5)
    own = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    heads = ["Word", "WORD", "word9", "Zoë", "ÉTÉ", "naïve", "日本", "e\u0301", "\u095f", "don't", "'s", "x<|endoftext|>", "<|", "½", ""]
    texts = [rng.choice(heads) + "".join(rng.choices(own, k=rng.randint(0, 4))) + rng.choice(["", "", " x", "s", "\u0301", "\t."])
             for _ in range(12000)]
    assert encode.apart
    wrong = [t for t, raw, enc in zip(texts, encode(texts), lib.encode_batch(texts, add_special_tokens=False))
             if np.frombuffer(raw, "<u4").tolist() != enc.ids]
    assert wrong == []


def test_token_ids_of_special_strings_in_any_case():
    from tokenizers import Tokenizer
    path = vocabulary(q_text.WORDS)
    lib = Tokenizer.from_file(path)
    own = [*SCRAPS, "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|STARTOFTEXT|>", "DON'T"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(own, k=rng.randint(0, 12))) for _ in range(1500)] + own + ["A<|EndOfText|>B.", "<|endoftext|>X"]
    encode = token_files.Ids(path)
    assert encode.apart
    for text, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_token_ids_of_long_texts_and_a_full_memory(monkeypatch):
    path = vocabulary(q_text.WORDS)
    text = " ".join(x for x in scraps(300) if x)
    whole = token_files.Ids(path)([text])
    monkeypatch.setattr(token_files, "LONG", 97)
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    assert token_files.Ids(path)([text]) == whole
    assert "".join(token_files.stretches("x" * 500)) == "x" * 500


@pytest.mark.parametrize("top", [1, 200, 256, 49408, 1 << 24, 1 << 32])
def test_codes_give_any_position(top):
    rng = np.random.default_rng(top % 97)
    values = rng.integers(0, top, 3000).astype(np.uint32)
    codes = token_files.Codes.from_bytes(token_files.Codes.of(values, np.array([0, 700, 700, 3000])).to_bytes())
    assert [codes[i] for i in range(0, 3000, 37)] == values[::37].tolist()
    for a, b in ((0, 3000), (511, 513), (512, 1024), (2999, 3000), (5, 5)):
        assert codes.slice(a, b).tolist() == values[a:b].tolist()
    assert codes.document(0).tolist() == [] and codes.document(3).tolist() == values[700:].tolist()


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    path, lib = vocabulary(q_text.WORDS), Tokenizer.from_file(vocabulary(q_text.WORDS))
    df = frame(spark, scraps(60)).unionByName(spark.createDataFrame([(None, "no id", "s", "x")], "doc_id bigint, text string, source string, ids string"))
    folder = scratch(spark, "token-files")
    token_files.write(df, folder, path, 2, segment_tokens=300)
    got = token_files.read(spark, folder).collect()
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (doc, text) in zip(sorted(got, key=lambda r: r.start), want):
        assert (r.doc_id, r.start, r.ids) == (doc, start, lib.encode(text, add_special_tokens=False).ids + [2])
        start += len(r.ids)
    assert len(got) == len(want)
    digests = {r.start: (r.doc_id, r.n_tokens, r.digest) for r in token_files.read(spark, folder, token_files.crc32).collect()}
    assert digests == {r.start: (r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    empty = scratch(spark, "token-files")
    token_files.write(df.limit(0), empty, path)
    assert token_files.read(spark, empty).count() == 0


def test_token_files_of_one_id_lie_in_many_tasks(spark):
    from tokenizers import Tokenizer
    path, lib = vocabulary(q_text.WORDS), Tokenizer.from_file(vocabulary(q_text.WORDS))
    rows = [(7, f"Text {i}, once more.") for i in range(600)] + [(i, "x") for i in (3, 9)] + [(None, f"lost {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = scratch(spark, "token-files")
    token_files.write(df, folder, path, 2, segment_tokens=50)
    segments = spark.read.parquet(folder)
    assert segments.where(F.array_contains("doc_ids", 7)).select("part").distinct().count() > 1
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [3] + [7] * 600 + [9]
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) for r in got]).tolist()[:-1]]
    want = [lib.encode(t, add_special_tokens=False).ids + [2] for _, t in rows]
    assert sorted(r.ids for r in got) == sorted(want)


def brute_hits(text, items, window=10):
    own, hit, found = decontaminate.words(text), set(), set()
    for item, t in items:
        w = decontaminate.words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(own) - n + 1):
                if own[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_decontamination_equals_brute_force(spark, slice_bytes):
    rng = random.Random(1)
    def text(n):
        return " ".join(rng.choice(["Ab", "cd", "é1", "x", "y-z"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 14]))) for i in range(12)] + [(99, None), (3, text(2))]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [" ".join([items[5][1] or "q"] * 3), "", "é" * 20]
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id int, text string")
    for r in decontaminate.find(df, bench, slice_bytes=slice_bytes).collect():
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute_hits(r.text, items)
    assert all(not r.spans for r in decontaminate.find(df, bench.limit(0)).collect())
    assert decontaminate.find(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 20, 20])
def test_benchmark_items_without_an_id_are_searched(spark, slice_bytes):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, passage), (None, "lone"), (4, "other words"), (None, None)], "item_id int, text string")
    df = spark.createDataFrame([(1, f"a {passage} b"), (2, "a lone word and other words"), (3, "nothing")], "doc_id bigint, text string")
    got = {r.key.doc_id: (sum(s.end - s.start for s in r.spans), r["items"])
           for r in decontaminate.find(df, bench, slice_bytes=slice_bytes).collect()}
    assert got == {1: (12, []), 2: (3, ["4"]), 3: (0, [])}


def test_searchers_are_built_in_the_tasks_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "Searcher", None)  # of the driver
    items = [(i, f"item number x{i} of many") for i in range(12)]
    df = frame(spark, ["an item number x3 of many, item number x7 of many", "item number", ""])
    found = decontaminate.find(df, spark.createDataFrame(items, "item_id int, text string"), slice_bytes=100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for r in found.collect():
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute_hits(r.text, items)


def brute_removed(docs, length):
    first = {}
    for d, b in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], d)
    out = []
    for d, b in docs:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            f = first[b[i:i + length]]
            if f is not None and (d is None or f < d):
                gone[i:i + length] = [True] * length
        out.append((d, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,hot", [(1 << 20, 2048), (400, 2048), (400, 2)])
def test_suffix_dedup_equals_brute_force(spark, block, hot):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(60, 200))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([*passages, "", "".join(rng.choice("xyzü ") for _ in range(rng.randint(0, 80)))]) for _ in range(3)]
        texts.append("".join(parts))
    texts += ["a" * 300, "a" * 200, "short", passages[0][10:70]]
    df = frame(spark, texts).unionByName(spark.createDataFrame([(None, texts[3], "s", "x")] * 2, "doc_id bigint, text string, source string, ids string"))
    got = suffix_dedup.dedup(df, block=block, hot=hot).collect()
    docs = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    assert sorted(((r.meta.doc_id, bytes(r.kept)) for r in got), key=repr) == brute_removed(docs, 50)
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in got)
    whole = suffix_dedup.dedup(df, block=block, hot=hot, whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_transform_and_common_prefixes():
    rng = random.Random(7)
    for k in range(60):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 9))] + [b"aaaaaaaa"] * (k % 3)
        bwt, lcp = suffix_dedup.build(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        rows = sorted((t[i:], j, t[i - 1:i]) for j, t in enumerate(texts) for i in range(len(t) + 1))
        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        letters = sorted(set(b"".join(texts)))
        assert sorted(bwt.tolist()) == sorted(letters.index(r[2][0]) + 1 if r[2] else 0 for r in rows)


def brute_components(fps, bits):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= bits:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_by_definition(spark):
    from xxhash import xxh64_intdigest
    for text in ("One two THREE four five", "one two", "", "É a\x0bb\tc", "x " * 100):
        w = [x for x in text.encode().lower().replace(b"\t", b" ").replace(b"\x0b", b" ").split(b" ") if x]
        shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text, 3) == want


@pytest.mark.parametrize("tile", [1024, 4])
def test_simhash_groups_equal_brute_force(spark, tile):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(14)] + [0, 0, 7]
    label = brute_components(fps, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in set(signed)], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 3, tile)).collect()}
    for i, a in enumerate(signed):
        for j, b in enumerate(signed):
            assert (roots.get(a, a) == roots.get(b, b)) == (label[i] == label[j])
    df = spark.createDataFrame([(10 + i, f, "mine") for i, f in enumerate(signed)] + [(None, 1 << 40, "mine")], "doc_id bigint, fp bigint, root string")
    got = {r.doc_id: r.component_id for r in simhash.group(df).collect()}
    assert got.pop(None) in (None, *got.values())
    assert got == {10 + i: 10 + label[i] for i in range(len(fps))}
    assert simhash.group(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    def text(toxic):
        words = ["".join(rng.choices(["an", "the", "ing", "er", "on"], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Grobble", "snarkoid"]))
        return " ".join(words)
    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "grobble")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows if i < 300] + [(5, None), (None, 1), (2000, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == x for i, _, x in rows if i >= 300)
    assert got[1000] == got[1001] < 0.7 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.fit(docs, labels.limit(0)).score("grobble") < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_is_fitted_on_one_row_of_an_id(spark, monkeypatch):
    fitted = []
    logistic = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda rows, *more: fitted.append(len(rows)) or logistic(rows, *more))
    rows = [(i, f"a text with {'grobble' if i % 2 else 'nothing'} in it {i}") for i in range(20)]
    docs = spark.createDataFrame(rows + [(3, f"z {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, max_rows=20)
    assert fitted == [20]
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, max_rows=20)
    assert model.kept.tolist() == once.kept.tolist() and model.score("grobble") == once.score("grobble")


def test_queries_over_tables(spark):
    """Digests of the registered queries against the libraries."""
    from sentencepiece import SentencePieceProcessor
    sf = "/root/testdata/sf0.001"
    lib = SentencePieceProcessor(model_file=vocabulary(q_text.PIECES))
    docs = {r.doc_id: r.text or "" for r in q_text.texts(spark, sf).collect()}
    for r in q_text.op1_sentencepiece(spark, sf).collect():
        ids = lib.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in q_text.op10_decontamination(spark, sf).collect():
        n, hit, found = brute_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items_sha256) == (n, hit, hashlib.sha256(",".join(found).encode()).hexdigest())
    kept = dict(brute_removed([(d, t.encode()) for d, t in docs.items()], 50))
    for r in q_text.op3_suffix_dedup(spark, sf).collect():
        assert r.kept_sha256 == hashlib.sha256(kept[r.doc_id]).hexdigest()
