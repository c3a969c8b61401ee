"""ML scores on Spark ML.

The recurrent classifier and the neural autoencoder of the reproduced
system are single-machine solvers; here they are re-aimed at distributed
Spark ML estimators with the same inputs and outputs:

* sequence classifier -> ``MultilayerPerceptronClassifier`` on the
  flattened 20 x 8 sequence;
* reconstruction model -> ``StandardScaler`` + ``PCA(k=16)`` (a linear
  autoencoder with the same bottleneck), error = mean squared residual;
* behaviour profiles -> ``StandardScaler`` + ``KMeans(k=5)``, best of
  several seeds by training cost.

The first two are fitted by the passes of ``fitting`` and are Spark's models.
Scoring never leaves the JVM: distances and residuals are array
expressions over ``vector_to_array``; cluster centres are a 5 x 8 literal.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..session import written
from .fitting import moments, network_weights
from .ordered import key_rank, last_n
from .quantile import exact_percentile
from .timeline import Trail, trailing

SEQ_DIM = config.SEQ_LEN * len(config.SEQUENCE_FEATURES)
_TWO_PI = 2 * math.pi


# ---------------------------------------------------------------- inputs

def sequence_features(tx: DataFrame) -> DataFrame:
    """The 8 per-transaction model inputs (UTC hour, ISO weekday)."""
    hour = F.hour("event_time").cast("double")
    dow = ((F.dayofweek("event_time") + 5) % 7).cast("double")   # Monday = 0
    return tx.withColumns({
        "amount_rial_norm": F.log1p(F.col("amount_rial").cast("double")) / F.lit(math.log1p(config.MAX_AMOUNT_RIAL)),
        "is_night_f": F.col("is_night").cast("double"),
        "ip_confidence_f": F.col("ip_confidence").cast("double"),
        "is_carrier_nat_f": F.col("is_carrier_nat").cast("double"),
        "hour_sin": F.sin(F.lit(_TWO_PI) * hour / 24),
        "hour_cos": F.cos(F.lit(_TWO_PI) * hour / 24),
        "day_of_week_sin": F.sin(F.lit(_TWO_PI) * dow / 7),
        "day_of_week_cos": F.cos(F.lit(_TWO_PI) * dow / 7),
    })


_VEC_COLS = ["amount_rial_norm", "is_night_f", "ip_confidence_f", "is_carrier_nat_f",
             "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]


def sequences(tx: DataFrame, key: str = "national_code", n: int = config.SEQ_LEN) -> DataFrame:
    """W2 + W4: for every transaction the last ``n`` transactions of its key
    (oldest first, zero-padded in front) flattened to ``seq`` (n*8 doubles),
    the ids in the window (``seq_ids``), its length, and the gap in hours to
    the previous transaction of the key (``gap_hours``, NULL for the first).
    """
    f = sequence_features(tx)
    ranked = key_rank(f, key)
    item = F.struct(F.col("transaction_id").alias("id"), F.array(*[F.col(c) for c in _VEC_COLS]).alias("v"))
    prev = F.lag("event_time", 1)
    w = last_n(ranked, key, item, n, extra={"_prev_ts": prev})
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(_VEC_COLS)), F.lit(n) - F.size("_items"))
    vecs = F.concat(zeros, F.col("_items.v"))
    gap = (F.unix_micros("event_time") - F.unix_micros("_prev_ts")) / F.lit(3_600_000_000.0)
    return (w.withColumn("seq", F.flatten(vecs))
             .withColumn("seq_ids", F.col("_items.id"))
             .withColumn("seq_len", F.size("_items"))
             .withColumn("gap_hours", gap)
             .drop("_items", "_prev_ts"))


def behavioral_30d(tx: DataFrame, key: str = "national_code", days: int = 30) -> DataFrame:
    """The 8 behaviour inputs over the trailing ``days`` (rows within
    [t - days, t], same-time rows included), per transaction.

    One timeline gives count, exact amount sums (decimal) for mean and sample
    std, night and fail counts, distinct IPs and devices and the first time in
    the window (for the mean gap)."""
    amt = F.col("amount_rial").cast("decimal(20,0)")
    measures = {"_n": F.lit(1).cast("bigint"), "_s1": amt.cast("decimal(28,0)"), "_s2": amt * amt,
                "_night": F.col("is_night").cast("bigint"),
                "_fail": F.when(F.col("result") == "FAILED", 1).otherwise(0).cast("bigint")}
    window = Trail(days * 86400, {m + "_w": m for m in measures},
                   {"unique_ips_30d": "ip_address", "unique_devices_30d": "device_fp_hash"}, first="_first")
    sw = trailing(tx, key, [window], measures)
    n = F.col("_n_w").cast("double")
    var_num = F.col("_n_w").cast("decimal(38,0)") * F.col("_s2_w") - F.col("_s1_w") * F.col("_s1_w")
    gap = F.when(F.col("_n_w") > 1, (F.unix_micros("event_time") - F.col("_first")) / F.lit(3_600_000_000.0) / (n - 1))
    return (sw.withColumn("avg_amount_30d", F.col("_s1_w").cast("double") / n)
              .withColumn("std_amount_30d", F.when(F.col("_n_w") > 1, F.sqrt(var_num.cast("double") / (n * (n - 1)))))
              .withColumn("night_ratio_30d", F.col("_night_w").cast("double") / n)
              .withColumn("fail_ratio_30d", F.col("_fail_w").cast("double") / n)
              .withColumn("tx_count_30d", F.col("_n_w").cast("long"))
              .withColumn("avg_tx_gap_hours_30d", gap)
              .drop(*[m + "_w" for m in measures], "_first"))


def behavioral_profile(tx: DataFrame, as_of: str, key: str = "national_code", days: int = 30) -> DataFrame:
    """W3 as a profile per key: the same 8 inputs over [as_of - days, as_of)
    as one partial aggregation (no per-key window)."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(days)} DAYS")
    t = tx.filter((F.col("event_time") >= start) & (F.col("event_time") < end))
    n = F.count(F.lit(1))
    span = (F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))) / F.lit(3_600_000_000.0)
    return t.groupBy(key).agg(
        F.avg("amount_rial").alias("avg_amount_30d"),
        F.stddev("amount_rial").alias("std_amount_30d"),
        F.avg(F.col("is_night").cast("int")).alias("night_ratio_30d"),
        (F.count(F.when(F.col("result") == "FAILED", 1)) / n).alias("fail_ratio_30d"),
        F.countDistinct("ip_address").alias("unique_ips_30d"),
        F.countDistinct("device_fp_hash").alias("unique_devices_30d"),
        n.alias("tx_count_30d"),
        F.when(n > 1, span / (n - 1)).alias("avg_tx_gap_hours_30d"),
    )


def behavior_vector(df: DataFrame, out: str = "behavior") -> DataFrame:
    """The 8 behaviour inputs as an ML vector (missing values read as 0)."""
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in config.BEHAVIORAL_FEATURES])
    return df.withColumn(out, array_to_vector(arr))


def sequence_vector(df: DataFrame, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector("seq"))


def spark_model(kind, stage, *parts):
    """Spark's model of the given parts, with the settings of its estimator."""
    sc = stage_context()
    java = getattr(sc._jvm.org.apache.spark.ml, kind.__module__.rsplit(".", 1)[1])
    made = kind(getattr(java, kind.__name__)(stage.uid, *[_py2java(sc, p) for p in parts]))
    return stage._copyValues(made)


def stage_context():
    from pyspark import SparkContext
    return SparkContext._active_spark_context


# ---------------------------------------------------------------- L1/L2

def fit_sequence_classifier(seq_df: DataFrame, label: str = "label", seed: int = 7,
                            max_iter: int = 50, hidden: tuple[int, ...] = (64, 32)) -> PipelineModel:
    """L1: supervised fraud probability from the flattened sequence."""
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                         layers=[SEQ_DIM, *hidden, 2], seed=seed, maxIter=max_iter,
                                         blockSize=64)
    sc, layers = stage_context(), mlp.getLayers()
    net = sc._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(_int_array(sc, layers), True)
    first = np.array(net.model(seed).weights().toArray())
    weights = network_weights(seq_df, "seq", F.col(label).cast("double"), layers, first, max_iter, mlp.getTol())
    return PipelineModel([spark_model(MultilayerPerceptronClassificationModel, mlp, Vectors.dense(weights))])


def _int_array(sc, values: list[int]):
    out = sc._gateway.new_array(sc._jvm.int, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out


def sequence_probability(model: PipelineModel, seq_df: DataFrame) -> DataFrame:
    """L2: probability of class 1 per row (``lstm_score``)."""
    out = model.transform(sequence_vector(seq_df))
    return out.withColumn("lstm_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- L3-L5

class ReconstructionModel:
    """Standardise, project on ``k`` principal components, measure the
    mean squared residual; the anomaly threshold is a percentile of the
    residuals of normal data."""

    def __init__(self, pipeline: PipelineModel, threshold: float | None = None):
        self.pipeline = pipeline
        self.threshold = threshold

    def errors(self, seq_df: DataFrame) -> DataFrame:
        """L4: ``recon_error`` per row, (|z|^2 - |P z|^2) / d (no UDF)."""
        out = self.pipeline.transform(sequence_vector(seq_df))
        z = vector_to_array("z")
        p = vector_to_array("pc")
        sq = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
        err = F.greatest(F.lit(0.0), (sq(z) - sq(p)) / F.lit(float(SEQ_DIM)))
        return out.withColumn("recon_error", err).drop("features", "z", "pc")

    def fit_threshold(self, normal_df: DataFrame, percentile: float = config.AE_PERCENTILE,
                      sketch: bool = False) -> float:
        """L5 + A11: threshold = percentile of normal errors, interpolated
        between ranks and exact at any size; ``sketch`` takes a value near it
        from one scan.  The selection reads the errors several times: they are
        computed once and written."""
        e = self.errors(normal_df).select("recon_error")
        if not sketch:
            e = written(e, "errors")
        if sketch:
            found = e.agg(F.percentile_approx("recon_error", percentile / 100.0, 10000)).first()[0]
        else:
            found = exact_percentile(e, "recon_error", percentile / 100.0)
        self.threshold = float(found)
        return self.threshold

    def anomaly(self, seq_df: DataFrame) -> DataFrame:
        """``ae_is_anomaly`` and ``ae_score`` = clip(err / (2 thr), 0, 1)."""
        if self.threshold is None:
            raise ValueError("threshold is not fitted: call fit_threshold first")
        e = self.errors(seq_df)
        thr = F.lit(self.threshold)
        return (e.withColumn("ae_is_anomaly", F.col("recon_error") > thr)
                 .withColumn("ae_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                                                        F.col("recon_error") / (thr * 2)))))

    def save(self, spark, path: str) -> None:
        """Pipeline plus a one-row threshold table beside it."""
        self.pipeline.write().overwrite().save(path + "/pipeline")
        spark.createDataFrame([(self.threshold,)], "threshold double").write.mode("overwrite").parquet(
            path + "/threshold")

    @classmethod
    def load(cls, spark, path: str) -> "ReconstructionModel":
        thr = spark.read.parquet(path + "/threshold").first()["threshold"]
        return cls(PipelineModel.load(path + "/pipeline"), thr)


def fit_reconstruction(seq_df_normal: DataFrame, k: int = config.AE_BOTTLENECK) -> ReconstructionModel:
    """L3: scaler and components from one pass; without variance a column is 0
    after scaling, as Spark's scaler leaves it."""
    scaler = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    pca = PCA(k=k, inputCol="z", outputCol="pc")
    _, mean, cov = moments(seq_df_normal, "seq", SEQ_DIM)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    unit = np.where(std > 0, 1 / np.where(std > 0, std, 1.0), 0.0)
    u, s, _ = np.linalg.svd(cov * np.outer(unit, unit))
    share = s / s.sum() if s.sum() > 0 else s
    return ReconstructionModel(PipelineModel([
        spark_model(StandardScalerModel, scaler, Vectors.dense(std), Vectors.dense(mean)),
        spark_model(PCAModel, pca, DenseMatrix(SEQ_DIM, k, u[:, :k].ravel(order="F")), Vectors.dense(share[:k]))]))


# ---------------------------------------------------------------- L6/L7

class BehaviorProfiler:
    """Standardised KMeans profiles of the behaviour vector."""

    def __init__(self, scaler, kmeans, centers_mode: str = "as_reference"):
        self.scaler = scaler
        self.kmeans = kmeans
        self.centers_mode = centers_mode

    def _centers_scaled(self) -> list[list[float]]:
        centers = [list(map(float, c)) for c in self.kmeans.clusterCenters()]
        if self.centers_mode == "scaled":
            return centers
        # "as_reference": the centres (already in scaled space) are scaled once
        # more before the mean distance is taken.
        mean = list(map(float, self.scaler.mean))
        std = list(map(float, self.scaler.std))
        return [[(c[i] - mean[i]) / (std[i] if std[i] != 0 else 1.0) for i in range(len(c))] for c in centers]

    def profile(self, df: DataFrame, multiplier: float = config.BEHAVIOR_MULTIPLIER) -> DataFrame:
        """Cluster id, profile name, distance to its centre, and the anomaly
        score min(1, d / (multiplier * mean distance to all centres))."""
        if self.kmeans is None:
            raise ValueError("profiler is not fitted: call fit_profiles first")
        v = self.scaler.transform(behavior_vector(df))
        out = self.kmeans.transform(v)
        z = vector_to_array("behavior_z")
        own = F.array(*[F.array(*[F.lit(x) for x in c]) for c in self.kmeans.clusterCenters()])
        allc = F.array(*[F.array(*[F.lit(x) for x in c]) for c in self._centers_scaled()])

        def dist(center: Column) -> Column:
            return F.sqrt(F.aggregate(F.zip_with(z, center, lambda a, b: (a - b) * (a - b)),
                                      F.lit(0.0), lambda acc, x: acc + x))

        names = F.array(*[F.lit(n) for n in config.PROFILE_NAMES])
        d_own = dist(F.element_at(own, F.col("cluster") + 1))
        d_mean = F.aggregate(F.transform(allc, dist), F.lit(0.0), lambda acc, x: acc + x) / F.lit(
            float(len(self.kmeans.clusterCenters())))
        lim = d_mean * F.lit(multiplier)
        return (out.withColumn("distance", d_own)
                   .withColumn("profile_name", F.coalesce(F.element_at(names, F.col("cluster") + 1),
                                                          F.lit(config.UNKNOWN_PROFILE)))
                   .withColumn("behavioral_anomaly", F.col("distance") > lim)
                   .withColumn("behavioral_score", F.least(F.lit(1.0), F.col("distance") / lim))
                   .drop("behavior", "behavior_z"))

    def save(self, path: str) -> None:
        self.scaler.write().overwrite().save(path + "/scaler")
        self.kmeans.write().overwrite().save(path + "/kmeans")

    @classmethod
    def load(cls, path: str) -> "BehaviorProfiler":
        from pyspark.ml.clustering import KMeansModel
        from pyspark.ml.feature import StandardScalerModel
        return cls(StandardScalerModel.load(path + "/scaler"), KMeansModel.load(path + "/kmeans"))


def fit_profiles(beh_df: DataFrame, k: int = config.N_CLUSTERS, seed: int = config.KMEANS_SEED,
                 starts: int = config.KMEANS_STARTS) -> BehaviorProfiler:
    """Standardise, then KMeans from ``starts`` seeds; keep the lowest cost."""
    v = behavior_vector(beh_df)
    scaler = StandardScaler(inputCol="behavior", outputCol="behavior_z", withMean=True, withStd=True).fit(v)
    z = scaler.transform(v).select("behavior_z").cache()
    best = None
    try:
        for i in range(starts):
            m = KMeans(k=k, seed=seed + i, featuresCol="behavior_z", predictionCol="cluster").fit(z)
            cost = m.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, m)
    finally:
        z.unpersist()
    return BehaviorProfiler(scaler, best[1])


# ---------------------------------------------------------------- L8

def combine_scores(df: DataFrame, lstm: str = "lstm_score", ae: str = "ae_score",
                   beh: str = "behavioral_score") -> DataFrame:
    """Weighted mean over the scores that are present (weights
    renormalised), none present -> 0.0; rounded to 4 places, capped at 1."""
    w = config.ML_WEIGHTS
    parts = [(F.col(lstm), w["lstm"]), (F.col(ae), w["autoencoder"]), (F.col(beh), w["behavioral"])]
    total = sum((F.coalesce(c * F.lit(wt), F.lit(0.0)) for c, wt in parts), F.lit(0.0))
    wsum = sum((F.when(c.isNotNull(), F.lit(wt)).otherwise(F.lit(0.0)) for c, wt in parts), F.lit(0.0))
    final = F.when(wsum > 0, total / wsum).otherwise(F.lit(0.0))
    score = F.bround(F.least(F.lit(1.0), final), 4)
    return df.withColumn("ml_score", score).withColumn("ml_is_anomaly", F.col("ml_score") >= 0.5)
