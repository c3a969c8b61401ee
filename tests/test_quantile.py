"""Exact percentiles against numpy."""
import numpy as np
import pytest

from ledgerlens.operators import quantile as Q


@pytest.mark.parametrize("few,bins", [(4096, 4096), (3, 4)])
def test_percentiles_equal_numpy(spark, monkeypatch, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    rng = np.random.default_rng(few)
    cases = [[1.0, 2.0, 4.0], [5.0], [2.0] * 50 + [3.0], (rng.standard_normal(300) ** 3).tolist(), [1e-300, 1e300, -1e300, 0.0, 1.0],
             [1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 0.0)] * 3]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        for share in (0.0, 0.5, 0.95, 1.0):
            want = float(np.percentile(values, 100 * share))
            assert abs(Q.exact_percentile(df, "x", share) - want) <= 1e-12 * max(1.0, abs(want)), (values[:5], share)
    assert Q.exact_percentile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_three_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert abs(Q.exact_percentile(df, "x", 0.95) - 3.8) < 1e-12
