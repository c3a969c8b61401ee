"""End-to-end scoring job (E3): transactions -> features -> rules -> decisions.

Plan shape: tx -> J9 (account dimension, limits broadcast) -> J8 (one
aggregate + join per entity and window) -> one projection (rules and
decision, whole-stage codegen, no UDF).
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.decision import decide
from ..operators.enrich import attach_features, attach_limits
from ..operators.rules import evaluate_rules


def rule_results(tx: DataFrame, mode: str = "tumbling", distinct: str = "exact") -> DataFrame:
    """Transactions (with account_type) -> rule results (alerts, score, block)."""
    feats = attach_features(tx, mode=mode, distinct=distinct)
    return evaluate_rules(attach_limits(feats))


def score(tx: DataFrame, ml_scores: DataFrame | None = None, mode: str = "tumbling",
          distinct: str = "exact") -> DataFrame:
    """Transactions -> final decisions."""
    return decide(rule_results(tx, mode, distinct), ml_scores)
