"""Embedding whitening against dense brute force."""
import numpy as np
import pytest

from ledgerlens.llm import catalog, whitening

SF = "/root/testdata/sf0.001"


def spread(rng, d):
    """A covariance with ties, close pairs and, at times, directions of none."""
    values = rng.choice([0, 1, 1, 2, 3, 3.0000001, 50], d) * rng.choice([1, 1e-6, 1e6])
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (turn * values) @ turn.T
    return (v + v.T) / 2, values


@pytest.mark.parametrize("d", [1, 2, 3, 7, 30, 90])
def test_inertia_and_components(d):
    rng = np.random.default_rng(d)
    for _ in range(12):
        v, values = spread(rng, d)
        for shift in (-1.0, 0.5, 1.5, 2.5):
            assert whitening.inertia(v - shift * np.eye(d)) == (np.linalg.eigvalsh(v) < shift).sum()
        want = np.sort(values)[::-1][:4]
        want = want[want > 1e-12 * values.sum()]
        got, vectors = whitening.feast(v, 4)
        assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9)
        if len(got):
            assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-12 * values.max()
            assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)


def test_inertia_of_zero_diagonals():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.inertia(np.array([[0.0, 2.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, -1.0]])) == 2
    assert whitening.inertia(np.zeros((3, 3))) == 0


def test_missed_components_widen_the_subspace(monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    v, values = spread(np.random.default_rng(5), 60)
    got, _ = whitening.feast(np.diag(np.linspace(1, 2, 60)), 4)
    assert np.allclose(got, np.linspace(1, 2, 60)[::-1][:4], rtol=1e-6)


def brute(vectors, wanted=4):
    """(rows, n, deviations, coordinates, shares) of equally long vectors."""
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    keep = e[:wanted] > 1e-12 * max(np.trace(v), 1e-300)
    e, q = e[:wanted][keep], q[:, :wanted][:, keep]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(e), e / max(np.trace(v), 1e-300)


def check(got, vectors):
    n, deviation, coordinates, shares = brute(vectors)
    assert len(got) == coordinates.size
    values = np.zeros(coordinates.shape)
    for r in got:
        at = r.row.vec_id, r.component - 1
        values[at] = r.whitened
        assert r.n == n and r.deviation == deviation[r.row.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / shares[at[1]] - 1) < 1e-9
    sign = np.sign((values * coordinates).sum(0))
    assert np.allclose(values, coordinates * sign, atol=1e-9)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((60, 6)) * [3, 2, 1, .5, .2, .1] + [900, 0, -5, 0, 0, 0]).tolist()
    vectors += [vectors[7]] * 40 + [[-0.0] * 6]
    schema = "vec_id bigint, embedding array<double>, size int, x string, row string, n int, y int"
    df = spark.createDataFrame([(i, v, 1, "x", "r", 5, 6) for i, v in enumerate(vectors)], schema)
    bad = spark.createDataFrame([(900, None, 1, "", "", 1, 1), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, "", "", 1, 1), (902, [float("nan")] * 6, 1, "", "", 1, 1),
                                 (903, [float("inf")] + [0.0] * 5, 1, "", "", 1, 1), (904, [], 1, "", "", 1, 1), (905, [2.0, 3.0], 1, "", "", 1, 1)], schema)
    got = whitening.whiten(df.union(bad).repartition(5)).collect()
    check(got, vectors)
    assert {c for r in got for c in r.row.asDict()} == {"vec_id", "embedding", "size", "x", "row", "n", "y"}


@pytest.mark.parametrize("sent", [0, 1 << 21])
def test_each_length_is_a_collection(spark, monkeypatch, sent):
    monkeypatch.setattr(whitening, "SENT", sent)
    rng = np.random.default_rng(2)
    short, long = rng.standard_normal((30, 2)).tolist(), rng.standard_normal((50, 9)).tolist()
    rows = [(i, v, "s") for i, v in enumerate(short)] + [(i, v, "l") for i, v in enumerate(long)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, kind string")).collect()
    for kind, vectors in (("s", short), ("l", long)):
        check([r for r in got if r.row.kind == kind], np.array(vectors, dtype=np.float32).tolist())


def test_few_rows_no_variance_and_nulls(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(None, [0.0, 0.0, 5.0]), (1, [2.0, 0.0, 5.0]), (1, [2.0, 0.0, 5.0])], schema)).collect()
    assert sorted((r.row.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got) == [
        (0, 1, 2, 512 ** 2, 1.0, 1.0), (1, 1, 2, 512 ** 2, 1.0, 1.0), (1, 1, 2, 512 ** 2, 1.0, 1.0)]
    far = whitening.whiten(spark.createDataFrame([(0, [0.0]), (1, [2.0 ** 40])], schema)).collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in far)


def test_the_sums_are_exact(spark):
    schema = "size int, x array<bigint>"
    xs = [[2 ** 62, -3], [2 ** 62 - 1, -4], [2 ** 62 - 5, 1]]
    got = whitening.centres(spark.createDataFrame([(2, x) for x in xs], schema)).first()
    assert (got.n, got.q, got.r) == (3, [2 ** 62 - 2, -2], [0, 0])


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = catalog.QUERIES["op12_whitening"][0](spark, SF).collect()
    assert len(got) == 4 * len(rows)
    n, deviation, coordinates, shares = brute([r.embedding for r in rows])
    by = {(r.vec_id, r.component): r for r in got}
    values = np.array([[by[r.vec_id, k].whitened for k in (1, 2, 3, 4)] for r in rows])
    assert np.allclose(np.abs(values), np.abs(coordinates), atol=1e-8)
    assert [by[r.vec_id, 1].deviation for r in rows] == deviation.tolist()
