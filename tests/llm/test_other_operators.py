"""Chat formatting, nearest neighbours, sharding and the pipeline."""
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import ann, catalog, chat, q_text, sharding, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    fn, sql = catalog.QUERIES[name]
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got, want = fn(spark, SF), db.sql(sql)
    at = [want.columns.index(c) for c in got.columns]
    assert len(at) == len(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


SCHEMAS = {"add": {"a": ("integer", True, 0, 9), "note": ("string", False, 2, 5), "deep": ("object", False, None, None)}}
MESSAGE = ("conv_id bigint, turn bigint, role string, text string, call_id string, tool string, arguments string, "
           "depends_on array<string>, result_id string")


def messages(spark, rows):
    full = [(c, t, role, text, *([*rest] + [None] * 5)[:5]) for c, t, role, text, *rest in rows]
    return spark.createDataFrame(full, MESSAGE)


def test_chat_links_orders_and_checks(spark):
    df = messages(spark, [
        (1, 5, "assistant", "x", "c", "add", '{"note":"ab","a" : 3, "deep":{"z":1.50,"b":[true,null]}}', ["a", "b", "gone"]),
        (1, 1, "assistant", "x", "a", "add", '{"a":"3"}', []),
        (1, 9, "assistant", "later", "a", "add", '{"a":4}', []),
        (1, 3, "assistant", "x", "b", "add", '{"a":12,"note":"toolong"}', ["a"]),
        (1, 6, "assistant", "x", "d", "add", "[1]", ["e"]), (1, 7, "assistant", "x", "e", "nope", "{}", ["d"]),
        (1, 8, "assistant", "x", "f", "add", None, ["d"]), (1, 8, "assistant", "x", None, "add", "{}", None),
        (1, 4, "tool", 'says "é"\n', None, None, None, None, "a"), (1, 6, "tool", "second", None, None, None, None, "a"),
        (1, 6, "tool", "nobody's", None, None, None, None, "zzz"), (2, 1, "assistant", None, "a", "add", '{"a":1}', None)])
    got = {(r.conv_id, r.call_id): r for r in chat.link(df, SCHEMAS).collect()}
    assert {k[1]: r.topo_level for k, r in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None}
    a, b, c = (got[1, x] for x in "abc")
    assert (a.turn, a.errors, a.result) == (1, ["a: not integer"], 'says "é"\n')
    assert b.errors == ["a: above 9", "note: above 5"] and b.result is None
    assert c.errors == [] and c.arguments == '{"a":3,"deep":{"b":[true,null],"z":1.5},"note":"ab"}'
    assert [got[1, x].errors for x in "def"] == [["not an object"], ["unknown tool"], ["not JSON"]]
    assert json.loads(a.call_json) == {"arguments": {"a": "3"}, "id": "a", "name": "add", "result": 'says "é"\n'}
    assert got[2, "a"].topo_level == 0
    assert chat.link(df.limit(0), SCHEMAS).count() == 0


def test_chat_keeps_results_that_no_call_holds(spark):
    df = messages(spark, [
        (1, 1, "assistant", "x", "a", "add", '{"a":1}', []), (1, 2, "tool", "used", None, None, None, None, "a"),
        (1, 2, "tool", "used", None, None, None, None, "a"), (1, 3, "tool", "second", None, None, None, None, "a"),
        (1, 4, "tool", "nobody's", None, None, None, None, "zzz"), (1, 5, "tool", None, None, None, None, None, None),
        (2, 1, "tool", "of another", None, None, None, None, "a"), (None, 1, "tool", "lost", None, None, None, None, "a")])
    got = sorted(map(tuple, chat.unlinked(df).collect()), key=repr)
    assert got == sorted([
        (1, 2, "a", "used", "further result"), (1, 3, "a", "second", "further result"), (1, 4, "zzz", "nobody's", "unknown call"),
        (1, 5, None, None, "no call id"), (2, 1, "a", "of another", "unknown call"), (None, 1, "a", "lost", "unknown call")], key=repr)
    assert [r.result for r in chat.link(df, SCHEMAS).collect()] == ["used"]
    assert chat.unlinked(df.limit(0)).count() == 0


def brute_nearest(rows, queries, k):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in x:
            s = [(-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q and len(v) == len(x[q])]
            out[q] = sorted(s, key=lambda p: (round(p[0], 12), p[1]))[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(300)]  # a hot vector
    rows += [(950, None), (1000, [0.0] * 24), (1050, [None] + [1.0] * 23), (1100, [float("nan")] * 24), (None, [1.0] * 24), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    f32 = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, v in rows]
    want = brute_nearest(f32, range(0, 1200, 50), 5)
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), block=64).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    assert [got[0][k][0] for k in range(1, 6)] == [600, 601, 602, 603, 604]  # ties to the smaller id
    hits = sum(len({i for _, i in want[q]} & {v[0] for v in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        x = dict(f32)
        for i, score in found.values():
            a, b = np.array(x[q]), np.array(x[i])
            assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    want = brute_nearest(rows, range(0, len(rows), 50), 5)
    got = {(r.query_id, r.vec_id) for r in catalog.QUERIES["op5_nearest_neighbours"][0](spark, "/root/testdata/sf0.1").collect()}
    assert len(got & {(q, i) for q, found in want.items() for _, i in found}) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("block", [4096, 2])
def test_few_far_and_opposite_vectors_are_found(spark, block):
    rng = np.random.default_rng(8)
    near = rng.normal(size=64)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(4)]  # a rare length
    rows += [(100 + i, (np.append(near, 1) + 0.01 * rng.normal(size=65)).tolist()) for i in range(40)]
    rows += [(50, rng.normal(size=64).tolist()), (150, (-np.append(near, 1)).tolist()), (200, rng.normal(size=7).tolist()), (250, [1.0, 2.0]),
             (300, (-np.append(near, 1) * 2).tolist()), (250, [2.0, 1.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = df.where("vec_id % 50 = 0")
    got = {}
    for r in ann.search(df, queries, block=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {q: list(enumerate((i for _, i in found), 1)) for q, found in
            brute_nearest([r for r in rows if r[0] != 250], range(0, 400, 50), 5).items() if found}
    want[250] = [(1, 7)]  # an id of two rows; the candidate counts once
    assert {q: len(v) for q, v in got.items()} == {0: 4, 50: 4, 100: 5, 150: 5, 250: 1, 300: 5}
    for q in (0, 50, 150, 250, 300):
        assert sorted(got[q]) == want[q]


def test_sharding_is_even_and_moves_little(spark):
    names = [f"s{i}" for i in range(10)]
    owner = sharding.fill(names, 1009)
    assert max(np.bincount(owner)) - min(np.bincount(owner)) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 9)
    assert moved < 0.25 * 1009
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c")], "doc_id bigint, slot string")
    rows = sharding.place(df, shards=names, slots=1009).collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(df.limit(0), shards=names, slots=1009).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("fp", F.lit("mine"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string")))
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), "test")
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "simhash_near_dedup":
            fps = [simhash.fingerprint(r.text or "", 3) for r in rows]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
        if name == "suffix_array_dedup":
            assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == docs.count()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        docs = out
    assert {r.doc_id for r in rows} <= set(before)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:1] == ["doc_id"] and 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
    assert q_text.TOXIC_FROM == 0.7
