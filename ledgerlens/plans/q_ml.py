"""Registered queries: model inputs and ML scores."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import config
from ..operators import ml as ML
from ..operators.ml_scoring import SCORES, ScoringModels, fit_models, model_inputs
from ..session import scratch_path, written
from ..sources import testdata as TD
from . import oracle as O
from .q_core import DECISION_COLUMNS, _decisions_sql, _feature_ctes, decision_columns
from .scoring import score

KEY = "national_code"


def q_ml_sequence_features(spark, sf):
    f = ML.sequence_features(TD.transactions(spark, sf))
    return f.select("transaction_id", *[F.round(c, 6).alias(c) for c in ML._VEC_COLS])


def q_ml_sequences(spark, sf):
    s = ML.sequences(TD.transactions(spark, sf), KEY)
    return s.select("transaction_id", F.col("seq_len").cast("long").alias("seq_len"),
                    F.array_join("seq_ids", ",").alias("seq_ids"),
                    F.round("gap_hours", 6).alias("gap_hours"),
                    F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x), 6).alias("seq_sum"))


def _beh_round(df):
    r = {"avg_amount_30d": 2, "std_amount_30d": 2, "night_ratio_30d": 6, "fail_ratio_30d": 6,
         "avg_tx_gap_hours_30d": 6}
    return [F.round(c, r[c]).alias(c) if c in r else F.col(c) for c in config.BEHAVIORAL_FEATURES]


def q_behavioral_30d(spark, sf):
    b = ML.behavioral_30d(TD.transactions(spark, sf), KEY)
    return b.select("transaction_id", *_beh_round(b))


def q_behavioral_profile(spark, sf):
    tx = TD.transactions(spark, sf)
    b = ML.behavioral_profile(tx, TD.end_of_data(tx), KEY)
    return b.select(KEY, *_beh_round(b))


def _synthetic_scores(df):
    """Score columns for the combiner, derived from transaction fields."""
    return (df.withColumn("lstm_score", F.col("amount_rial_norm"))
              .withColumn("ae_score", F.when(F.col("channel") != "view", F.col("ip_confidence") / 2))
              .withColumn("behavioral_score", F.when(F.col("result") != "FAILED",
                                                     F.hour("event_time").cast("double") / 23)))


def q_ml_combine(spark, sf):
    f = _synthetic_scores(ML.sequence_features(TD.transactions(spark, sf)))
    return ML.combine_scores(f).select("transaction_id", "ml_score", "ml_is_anomaly")


def _labelled_sequences(spark, sf):
    """Sequences and labels, written once: the fits and scores read them many times."""
    s = ML.sequences(TD.transactions(spark, sf), KEY)
    return written(s.select("transaction_id", "seq", (F.col("result") == "FAILED").cast("double").alias("label")), "sequences")


def q_ml_sequence_probability(spark, sf):
    s = _labelled_sequences(spark, sf)
    model = ML.fit_sequence_classifier(s, max_iter=20)
    return ML.sequence_probability(model, s).select("transaction_id", "label", "lstm_score")


def q_ml_anomaly(spark, sf):
    s = _labelled_sequences(spark, sf)
    normal = s.filter(F.col("label") == 0)
    m = ML.fit_reconstruction(normal)
    m.fit_threshold(normal)
    return m.anomaly(s).select("transaction_id", "recon_error", "ae_is_anomaly", "ae_score")


def q_ml_profiles(spark, sf):
    tx = TD.transactions(spark, sf)
    b = ML.behavioral_profile(tx, TD.end_of_data(tx), KEY)
    p = ML.fit_profiles(b)
    return p.profile(b).select(KEY, "cluster", "profile_name", "distance", "behavioral_anomaly",
                               "behavioral_score")


# ---------------------------------------------------------------- SQL twins

_FEATS_SQL = f"""
f AS (SELECT *, ln(1 + amount_rial) / {math.log1p(config.MAX_AMOUNT_RIAL)!r} AS amount_rial_norm,
  CAST(is_night AS DOUBLE) AS is_night_f, ip_confidence AS ip_confidence_f,
  CAST(is_carrier_nat AS DOUBLE) AS is_carrier_nat_f,
  sin({2 * math.pi!r} * hour(event_time) / 24) AS hour_sin, cos({2 * math.pi!r} * hour(event_time) / 24) AS hour_cos,
  sin({2 * math.pi!r} * (isodow(event_time) - 1) / 7) AS day_of_week_sin,
  cos({2 * math.pi!r} * (isodow(event_time) - 1) / 7) AS day_of_week_cos
FROM tx)"""

SQL_SEQUENCE_FEATURES = O.with_tx(
    "SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ML._VEC_COLS) + " FROM f", _FEATS_SQL)

_ROWSUM = " + ".join(ML._VEC_COLS)
SQL_SEQUENCES = O.with_tx(f"""
SELECT transaction_id,
  count(*) OVER w AS seq_len,
  array_to_string(list(transaction_id) OVER w, ',') AS seq_ids,
  round((epoch_us(event_time) - epoch_us(lag(event_time) OVER o)) / 3600000000.0, 6) AS gap_hours,
  round(sum({_ROWSUM}) OVER w, 6) AS seq_sum
FROM f
WINDOW o AS (PARTITION BY {KEY} ORDER BY event_time, transaction_id),
       w AS (PARTITION BY {KEY} ORDER BY event_time, transaction_id ROWS BETWEEN {config.SEQ_LEN - 1} PRECEDING AND CURRENT ROW)""",
    _FEATS_SQL)

SQL_BEHAVIORAL_30D = O.with_tx(f"""
SELECT transaction_id,
  round(avg(amount_rial) OVER w, 2) AS avg_amount_30d,
  round(stddev_samp(amount_rial) OVER w, 2) AS std_amount_30d,
  round(avg(CAST(is_night AS INTEGER)) OVER w, 6) AS night_ratio_30d,
  round(count(*) FILTER (WHERE result = 'FAILED') OVER w / count(*) OVER w, 6) AS fail_ratio_30d,
  count(DISTINCT ip_address) OVER w AS unique_ips_30d,
  count(DISTINCT device_fp_hash) OVER w AS unique_devices_30d,
  count(*) OVER w AS tx_count_30d,
  round(CASE WHEN count(*) OVER w > 1 THEN (epoch_us(event_time) - epoch_us(min(event_time) OVER w)) / 3600000000.0
             / (count(*) OVER w - 1) END, 6) AS avg_tx_gap_hours_30d
FROM tx
WINDOW w AS (PARTITION BY {KEY} ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")

SQL_BEHAVIORAL_PROFILE = O.with_tx(f"""
SELECT {KEY},
  round(avg(amount_rial), 2) AS avg_amount_30d,
  round(stddev_samp(amount_rial), 2) AS std_amount_30d,
  round(avg(CAST(is_night AS INTEGER)), 6) AS night_ratio_30d,
  round(count(*) FILTER (WHERE result = 'FAILED') / count(*), 6) AS fail_ratio_30d,
  count(DISTINCT ip_address) AS unique_ips_30d,
  count(DISTINCT device_fp_hash) AS unique_devices_30d,
  count(*) AS tx_count_30d,
  round(CASE WHEN count(*) > 1 THEN (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 3600000000.0
             / (count(*) - 1) END, 6) AS avg_tx_gap_hours_30d
FROM tx
WHERE event_time >= {O.END_OF_DATA} - INTERVAL 30 DAYS AND event_time < {O.END_OF_DATA}
GROUP BY {KEY}""")

_W = config.ML_WEIGHTS
_SCORED_CTES = [f"""
s AS (SELECT transaction_id, amount_rial_norm AS l,
               CASE WHEN channel <> 'view' THEN ip_confidence / 2 END AS a,
               CASE WHEN result <> 'FAILED' THEN CAST(hour(event_time) AS DOUBLE) / 23 END AS b FROM f)""", f"""
c AS (SELECT transaction_id,
        0.0 + coalesce(l * {_W['lstm']}, 0.0) + coalesce(a * {_W['autoencoder']}, 0.0) + coalesce(b * {_W['behavioral']}, 0.0) AS total,
        0.0 + CASE WHEN l IS NOT NULL THEN {_W['lstm']} ELSE 0.0 END + CASE WHEN a IS NOT NULL THEN {_W['autoencoder']} ELSE 0.0 END
            + CASE WHEN b IS NOT NULL THEN {_W['behavioral']} ELSE 0.0 END AS wsum FROM s)""", """
combined AS (SELECT transaction_id, round_even(least(1.0, CASE WHEN wsum > 0 THEN total / wsum ELSE 0.0 END), 4) AS ml FROM c)"""]

SQL_ML_COMBINE = O.with_tx("SELECT transaction_id, ml AS ml_score, ml >= 0.5 AS ml_is_anomaly FROM combined",
                           _FEATS_SQL, *_SCORED_CTES)


def q_risk_decisions_scored(spark, sf):
    """Decisions with model scores by transaction id."""
    tx = TD.transactions(spark, sf)
    scores = ML.combine_scores(_synthetic_scores(ML.sequence_features(tx)))
    scores = scores.select("transaction_id", "ml_score", "lstm_score", "ae_score", "behavioral_score")
    return decision_columns(score(tx, scores))


SQL_RISK_DECISIONS_SCORED = _decisions_sql(
    DECISION_COLUMNS.replace("0.0::DOUBLE AS ml_score", "ml_score"), [*_feature_ctes(), _FEATS_SQL, *_SCORED_CTES],
    ml="combined.ml", scores="LEFT JOIN combined USING (transaction_id)")


def q_ml_decisions(spark, sf):
    """The models fitted on the transactions (a failed one is
    label 1), kept and loaded again (S8), every transaction decided with its scores."""
    tx = TD.transactions(spark, sf)
    path = scratch_path(spark, f"models-{TD._fingerprint(spark, sf)}")
    # no model reads the ids, lengths and gaps of the sequences
    model_inputs(tx, KEY).drop("seq_ids", "seq_len", "gap_hours").write.mode("overwrite").parquet(path + "/inputs")
    inputs = spark.read.parquet(path + "/inputs")
    behavior = ML.behavioral_profile(tx, TD.end_of_data(tx), KEY)
    fit_models(inputs, F.col("result") == "FAILED", behavior, max_iter=20).save(spark, path)
    scored = ScoringModels.load(spark, path).apply(inputs).select(*tx.columns, *SCORES)
    return decision_columns(score(scored), "lstm_score", "ae_score", "behavioral_score", "profile_name")


QUERIES = {
    "ml_sequence_features": (q_ml_sequence_features, SQL_SEQUENCE_FEATURES),
    "ml_sequences": (q_ml_sequences, SQL_SEQUENCES),
    "behavioral_30d": (q_behavioral_30d, SQL_BEHAVIORAL_30D),
    "behavioral_profile": (q_behavioral_profile, SQL_BEHAVIORAL_PROFILE),
    "ml_combine": (q_ml_combine, SQL_ML_COMBINE),
    "risk_decisions_scored": (q_risk_decisions_scored, SQL_RISK_DECISIONS_SCORED),
    "ml_decisions": (q_ml_decisions, None),
    "ml_sequence_probability": (q_ml_sequence_probability, None),
    "ml_anomaly": (q_ml_anomaly, None),
    "ml_profiles": (q_ml_profiles, None),
}
