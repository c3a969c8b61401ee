"""Columns with clashing names and very long texts."""
import random

import numpy as np
from xxhash import xxh64_intdigest

from ledgerlens.llm import ann, chat, decontaminate, q_text, simhash, token_count, token_files
from ledgerlens.llm.common import GROUP_BYTES, scratch, vocabulary

WORD = ["Alpha", "béta,", "gamma", "42", "ΔELTA", "x.", "日本", "to"]


def long_text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORD) + (str(rng.randrange(999)) if rng.random() < 0.2 else "") for _ in range(n))


def clashing(df, *names):
    return df.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])


def test_names_that_operators_use_themselves(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "vec_id bigint, embedding array<double>")
    more = clashing(vectors, "id", "v", "vec", "len", "tab", "bucket", "block", "blocks", "query_id", "rank", "score")
    rows = [sorted(map(tuple, ann.search(v, v.where("vec_id % 10 = 0")).collect())) for v in (vectors, more)]
    assert rows[0] == rows[1] and len(rows[0]) == 20

    calls = spark.createDataFrame(
        [(1, 1, "assistant", "x", "a", "add", '{"a":1}', None, None), (1, 2, "tool", "r", None, None, None, None, "a"),
         (1, 3, "assistant", "x", "b", "add", '{"a":2}', ["a"], None), (1, 4, "tool", "s", None, None, None, None, "q")],
        "conv_id bigint, turn bigint, role string, text string, call_id string, tool string, arguments string, "
        "depends_on array<string>, result_id string")
    more = clashing(calls, "c", "_parsed", "parent", "topo_level", "errors", "result", "result_turn", "call_json", "n", "first", "called")
    schemas = {"add": {"a": ("integer", True, 0, 9)}}
    for fn in (lambda m: chat.link(m, schemas), chat.unlinked):
        assert sorted(map(tuple, fn(calls).collect()), key=repr) == sorted(map(tuple, fn(more).collect()), key=repr)

    docs = spark.createDataFrame([(i, f"Text number {i}.") for i in range(9)], "doc_id bigint, text string")
    more = clashing(docs, "id", "part", "seg", "before", "n_tokens", "doc_ids", "blob", "start")
    read = []
    for df in (docs, more):
        folder = scratch(spark, "token-files")
        token_files.write(df, folder, vocabulary(q_text.WORDS))
        read.append(sorted(map(tuple, token_files.read(spark, folder, token_files.crc32).collect())))
    assert read[0] == read[1] and len(read[0]) == 9

    more = clashing(docs, "key", "n_words", "spans", "items", "item_id")
    items = clashing(spark.createDataFrame([(5, "number 4")], "item_id int, text string"), "key", "items", "slice")
    got = {r.key.doc_id: (r.n_words, len(r.spans), r["items"], r.key.n_words) for r in decontaminate.find(more, items).collect()}
    assert got == {i: (3, int(i == 4), ["5"] if i == 4 else [], "mine") for i in range(9)}


def test_one_text_longer_than_a_group(spark):
    from tokenizers import Tokenizer
    path = vocabulary(q_text.BYTES)
    text = long_text(400_000, 2)
    assert len(text.encode()) > GROUP_BYTES
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, path).collect()}
    lib = Tokenizer.from_file(path)
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in ((1, text), (2, "short"))}


def test_fingerprint_of_more_shingles_than_are_hashed_at_once():
    words = long_text(simhash.HASHES + 3000, 3).encode().lower().split()
    counts = np.zeros(64, dtype=int)
    for i in range(len(words) - 2):
        h = xxh64_intdigest(b" ".join(words[i:i + 3]), 42)
        counts += [h >> b & 1 for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)
    assert simhash.fingerprint(long_text(simhash.HASHES + 3000, 3), 3) == want


def test_a_passage_at_the_end_of_a_long_text_is_found(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{long_text(200_000, 4)} {passage}")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage)], "item_id int, text string")
    row, = decontaminate.find(df, items).collect()
    assert [(s.start, s.end) for s in row.spans] == [(row.n_words - 12, row.n_words)] and row["items"] == ["7"]
