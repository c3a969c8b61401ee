"""The models together (L1-L8): fitted once, then every transaction scored in
one pass, with the columns that the decision takes in (J10, D1)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ml as ML

SCORES = ["ml_score", "ml_is_anomaly", "lstm_score", "ae_score", "behavioral_score", "profile_name"]


def model_inputs(tx: DataFrame, key: str = "national_code") -> DataFrame:
    """Transactions with the last sequence and the 30-day behaviour of their
    key; no join, so repeated transaction ids stay single."""
    return ML.sequences(ML.behavioral_30d(tx, key), key)


@dataclass
class ScoringModels:
    """Any model may be missing: its score is null and the others' weights
    make up for it."""
    sequence: PipelineModel | None = None
    reconstruction: ML.ReconstructionModel | None = None
    profiles: ML.BehaviorProfiler | None = None

    def apply(self, inputs: DataFrame) -> DataFrame:
        """Model inputs with the columns ``SCORES``."""
        out = inputs
        out = (ML.sequence_probability(self.sequence, out) if self.sequence
               else out.withColumn("lstm_score", F.lit(None).cast("double")))
        out = (self.reconstruction.anomaly(out) if self.reconstruction
               else out.withColumn("ae_score", F.lit(None).cast("double")))
        out = (self.profiles.profile(out) if self.profiles
               else out.withColumns({"behavioral_score": F.lit(None).cast("double"), "profile_name": F.lit(None).cast("string")}))
        return ML.combine_scores(out)

    def attach(self, tx: DataFrame, key: str = "national_code") -> DataFrame:
        """``tx`` with the columns ``SCORES``; ``decide`` takes them as they are."""
        return self.apply(model_inputs(tx, key)).select(*[F.col(f"`{c}`") for c in tx.columns], *SCORES)

    def scores(self, tx: DataFrame, key: str = "national_code") -> DataFrame:
        """One row a transaction row: its id and its scores."""
        return self.attach(tx, key).select("transaction_id", *SCORES)

    def save(self, spark: SparkSession, path: str) -> None:
        """The models beside each other, and which there are."""
        if self.sequence:
            self.sequence.write().overwrite().save(path + "/sequence")
        if self.reconstruction:
            self.reconstruction.save(spark, path + "/reconstruction")
        if self.profiles:
            self.profiles.save(path + "/profiles")
        there = [(n,) for n in ("sequence", "reconstruction", "profiles") if getattr(self, n)]
        spark.createDataFrame(there, "model string").write.mode("overwrite").parquet(path + "/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScoringModels":
        there = {r.model for r in spark.read.parquet(path + "/models").collect()}
        return cls(PipelineModel.load(path + "/sequence") if "sequence" in there else None,
                   ML.ReconstructionModel.load(spark, path + "/reconstruction") if "reconstruction" in there else None,
                   ML.BehaviorProfiler.load(path + "/profiles") if "profiles" in there else None)


def fit_models(inputs: DataFrame, label: Column, behavior: DataFrame, max_iter: int = 50) -> ScoringModels:
    """The sequence model on all labelled ``model_inputs``, the
    reconstruction and its threshold on those of label 0, the profiles on the
    rows of ``behavior`` (``ml.behavioral_profile``).  The fits read ``inputs`` many
    times: hand over a written table."""
    rows = inputs.withColumn("label", label.cast("double"))
    normal = rows.filter(F.col("label") == 0)
    reconstruction = ML.fit_reconstruction(normal)
    reconstruction.fit_threshold(normal)
    sequence = ML.fit_sequence_classifier(rows.filter(F.col("label").isNotNull()), max_iter=max_iter)
    return ScoringModels(sequence, reconstruction, ML.fit_profiles(behavior))
