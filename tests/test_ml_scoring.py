"""The models against plain numpy, their round trip, and decisions with their scores."""
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import config
from ledgerlens.operators import ml as ML
from ledgerlens.operators.decision import decide
from ledgerlens.operators.ml_scoring import SCORES, ScoringModels, fit_models, model_inputs

SCHEMA = ("transaction_id string, s long, amount_rial long, national_code string, ip_address string, device_fp_hash string, "
          "ip_confidence double, is_carrier_nat boolean, is_night boolean, result string, account_number string")


@pytest.fixture(scope="module")
def tx(spark):
    rng = np.random.default_rng(4)
    rows = [(f"T{i}", int(rng.integers(0, 20 * 86_400)), int(rng.integers(1, 900)) * 100_000, f"N{rng.integers(0, 9)}",
             f"I{rng.integers(0, 4)}", f"D{rng.integers(0, 4)}", float(rng.choice([0.3, 1.0])), bool(rng.integers(0, 2)),
             bool(rng.integers(0, 2)), str(rng.choice(["FAILED", "SUCCESS"])), "A") for i in range(160)]
    rows.append(rows[0])  # a row that comes twice
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


@pytest.fixture(scope="module")
def fitted(spark, tx, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    model_inputs(tx).write.parquet(path + "/inputs")
    inputs = spark.read.parquet(path + "/inputs")
    behavior = ML.behavioral_profile(tx, "2024-01-01 00:00:00", days=90)
    models = fit_models(inputs, F.col("result") == "FAILED", behavior, max_iter=5)
    return inputs, models, models.apply(inputs).toPandas()


def test_scores_equal_plain_numpy(fitted):
    _, models, got = fitted
    assert len(got) == 161
    x = np.stack(got.seq.to_numpy())
    # L2: the network, layer by layer
    net = models.sequence.stages[0]
    w, sizes, at, h = net.weights.toArray(), [ML.SEQ_DIM, 64, 32, 2], 0, x
    for i, (m, n) in enumerate(zip(sizes, sizes[1:])):
        z = h @ w[at:at + m * n].reshape(n, m, order="F").T  # column-major weights, then the offsets
        z, at = z + w[at + m * n:at + m * n + n], at + m * n + n
        h = 1 / (1 + np.exp(-z)) if i < 2 else np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    np.testing.assert_allclose(got.lstm_score, h[:, 1], atol=1e-9)
    # Residual beside the principal components, threshold from normal rows
    scaler, pca = models.reconstruction.pipeline.stages
    mean, std, pc = scaler.mean.toArray(), scaler.std.toArray(), pca.pc.toArray()
    z = (x - mean) * np.where(std > 0, 1 / np.where(std > 0, std, 1), 0)
    error = ((z - z @ pc @ pc.T) ** 2).mean(1)
    np.testing.assert_allclose(got.recon_error, error, atol=1e-9)
    threshold = np.percentile(error[got.result != "FAILED"], config.AE_PERCENTILE)
    assert models.reconstruction.threshold == pytest.approx(threshold, rel=1e-9)
    np.testing.assert_allclose(got.ae_score, np.clip(error / (2 * threshold), 0, 1), atol=1e-9)
    assert (got.ae_is_anomaly == (error > threshold)).all()
    # Nearest centre of the standardised behaviour
    b = got[config.BEHAVIORAL_FEATURES].astype(float).fillna(0.0).to_numpy()
    mean, std = models.profiles.scaler.mean.toArray(), models.profiles.scaler.std.toArray()
    scale = np.where(std > 0, std, 1)
    z = np.where(std > 0, (b - mean) / scale, 0)
    centers = np.array(models.profiles.kmeans.clusterCenters())
    d = np.linalg.norm(z[:, None] - centers, axis=2)
    near = d.argmin(1)
    assert (got.cluster == near).all()
    twice = np.linalg.norm(z[:, None] - (centers - mean) / scale, axis=2).mean(1)
    np.testing.assert_allclose(got.behavioral_score, np.minimum(1, d.min(1) / (config.BEHAVIOR_MULTIPLIER * twice)), atol=1e-9)
    names = [config.PROFILE_NAMES[c] if c < len(config.PROFILE_NAMES) else config.UNKNOWN_PROFILE for c in near]
    assert list(got.profile_name) == names
    # L8
    k = config.ML_WEIGHTS
    total = got.lstm_score * k["lstm"] + got.ae_score * k["autoencoder"] + got.behavioral_score * k["behavioral"]
    np.testing.assert_allclose(got.ml_score, np.minimum(1, total / sum(k.values())), atol=5.01e-5)


def test_models_come_back_the_same(spark, fitted, tmp_path):
    inputs, models, got = fitted
    models.save(spark, str(tmp_path))
    again = ScoringModels.load(spark, str(tmp_path)).apply(inputs)
    key = ["transaction_id", "amount_rial"]
    assert again.select(*key, *SCORES).toPandas().sort_values(key).values.tolist() == got[key + SCORES].sort_values(key).values.tolist()


def test_missing_models_leave_their_weight_to_the_others(fitted, tx):
    _, models, got = fitted
    only = ScoringModels(reconstruction=models.reconstruction)
    rows = only.attach(tx).toPandas()
    assert rows.lstm_score.isna().all() and rows.profile_name.isna().all()
    assert list(rows.columns) == tx.columns + SCORES and len(rows) == 161
    np.testing.assert_allclose(rows.ml_score, rows.ae_score.round(4), atol=5.01e-5)
    assert (ScoringModels().scores(tx).toPandas().ml_score == 0).all()


def test_decisions_take_the_scores_in(spark):
    alerts = "array<struct<rule_code: string, severity: string, message: string>>"
    rows = [(f"T{i}", "A", rule, block, [], ml) for i, (rule, block, ml) in enumerate(
        [(1.0, True, 1.0), (1.0, False, 0.5), (0.9, False, 0.9), (0.65, False, 0.53), (0.25, False, 0.4), (0.0, False, 1.0), (0.4, True, None)])]
    schema = f"transaction_id string, account_number string, risk_score double, should_block boolean, alerts {alerts}, ml_score double"
    whole = spark.createDataFrame(rows, schema)
    ruled, scores = whole.drop("ml_score"), whole.select("transaction_id", "ml_score")
    got = {r.transaction_id: r for r in decide(ruled, scores).collect()}
    for tid, _, rule, block, _, ml in rows:
        exact = Decimal(repr(rule)) * Decimal("0.6") + Decimal(repr(ml or 0.0)) * Decimal("0.4")
        final = float(min(Decimal(1), exact.quantize(Decimal("0.0001"), ROUND_HALF_EVEN)))
        level = "critical" if final >= 0.8 else "high" if final >= 0.6 else "medium" if final >= 0.3 else "low"
        assert (got[tid].risk_score, got[tid].risk_level, got[tid].should_block) == (final, level, block or final >= 0.7), tid
    assert {r.risk_level for r in got.values()} == {"critical", "high", "medium", "low"}
