"""Fits by matrices against Spark's estimators."""
import os
import urllib.parse

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerlens.operators import fitting
from ledgerlens.operators import ml as ML
from ledgerlens.session import checkpoint_dir


@pytest.fixture(scope="module")
def vectors(spark):
    """640 rows, whole stacks of 64 in one partition, one column constant."""
    rng = np.random.default_rng(5)
    x = rng.random((640, ML.SEQ_DIM)).round(3)
    x[:100, :40], x[:, 3] = 0.0, 0.5
    y = (x[:, 5:25].sum(1) + rng.random(640) > 10.5).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "seq array<double>, label double")
    return df.coalesce(1).cache(), x, y


def test_network_equals_sparks(vectors):
    df, _, _ = vectors
    got = ML.fit_sequence_classifier(df, max_iter=20).stages[0]
    mlp = MultilayerPerceptronClassifier(layers=[ML.SEQ_DIM, 64, 32, 2], seed=7, maxIter=20, blockSize=64, labelCol="label")
    want = mlp.fit(df.withColumn("features", array_to_vector("seq")))
    start = MultilayerPerceptronClassifier(layers=[ML.SEQ_DIM, 64, 32, 2], seed=7, maxIter=1, blockSize=64, labelCol="label")
    moved = np.abs(start.fit(df.withColumn("features", array_to_vector("seq"))).weights.toArray() - want.weights.toArray()).max()
    assert moved > 0.01
    np.testing.assert_allclose(got.weights.toArray(), want.weights.toArray(), atol=1e-6)
    assert got.getLayers() == want.getLayers()


def test_rows_in_any_partitions_give_one_network(vectors):
    df, _, _ = vectors
    one = ML.fit_sequence_classifier(df, max_iter=5).stages[0].weights.toArray()
    many = ML.fit_sequence_classifier(df.repartition(7), max_iter=5).stages[0].weights.toArray()
    np.testing.assert_allclose(many, one, atol=1e-7)


def test_matrices_are_small_and_read_by_every_evaluation(spark, vectors, monkeypatch):
    df, x, _ = vectors
    root = urllib.parse.urlparse(checkpoint_dir(spark)).path
    before = set(os.listdir(root))
    blocks = fitting.packed(df, "seq", F.col("label"), ML.SEQ_DIM, 2)
    made = [os.path.join(d, f) for t in set(os.listdir(root)) - before for d, _, fs in os.walk(os.path.join(root, t)) for f in fs]
    assert 0 < sum(map(os.path.getsize, made)) < 0.7 * x.nbytes
    assert blocks.agg(F.sum("n")).first()[0] == 640


def test_gradient_by_differences():
    rng, layers = np.random.default_rng(1), [4, 3, 3, 2]
    w, x, y = rng.normal(size=4 * 3 + 3 + 3 * 3 + 3 + 3 * 2 + 2), rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    grad = np.zeros(len(w))
    fitting.loss_and_gradient(w, layers, x, y, grad)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        up, down = (fitting.loss_and_gradient(w + s * e, layers, x, y, np.zeros(len(w))) for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(grad[i], abs=1e-6)


def test_components_equal_sparks(vectors):
    df, x, _ = vectors
    scaler, pca = ML.fit_reconstruction(df).pipeline.stages
    data = df.withColumn("features", array_to_vector("seq"))
    want = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(data)
    np.testing.assert_allclose(scaler.mean.toArray(), want.mean.toArray(), atol=1e-12)
    np.testing.assert_allclose(scaler.std.toArray(), want.std.toArray(), atol=1e-12)
    assert scaler.std.toArray()[3] == 0
    other = PCA(k=16, inputCol="z", outputCol="pc").fit(want.transform(data))
    np.testing.assert_allclose(np.abs(pca.pc.toArray()), np.abs(other.pc.toArray()), atol=1e-6)
    np.testing.assert_allclose(pca.explainedVariance.toArray(), other.explainedVariance.toArray(), atol=1e-9)


def test_rows_that_cannot_be_fitted(spark):
    schema = "seq array<double>, label double"
    good = [0.5] * ML.SEQ_DIM
    for rows in ([(good, 2.0)], [(good[1:], 1.0)], [([float("nan"), *good[1:]], 0.0)], [(good, None)]):
        with pytest.raises(Exception):
            ML.fit_sequence_classifier(spark.createDataFrame(rows, schema), max_iter=2)
    empty = spark.createDataFrame([], schema)
    with pytest.raises(ValueError):
        ML.fit_sequence_classifier(empty, max_iter=2)
    with pytest.raises(ValueError):
        ML.fit_reconstruction(empty)
