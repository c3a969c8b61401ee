"""Shared entities: lists go to the seeds, candidates are not shuffled row by row."""
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import graph as G


def test_order_and_rank_equal_all_pairs_over_several_labels(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{i:03d}", label, f"{label}{int(rng.integers(0, 6))}", float(rng.choice([0.4, 0.5, 0.75, 1.0])))
            for i in range(150) for label in ("Device", "IP", "Card") if rng.random() < 0.8]
    edges = spark.createDataFrame(rows, "from_id string, to_label string, to_id string, confidence double")
    e = [r for r in rows if r[3] >= 0.5]
    want = set()
    for seed in {r[0] for r in e}:
        pairs = sorted((-c1, -c2, q, label, i) for p, label, i, c1 in e if p == seed
                       for q, label2, i2, c2 in e if (label2, i2) == (label, i) and q != seed)
        want |= {(seed, q, label, i, -c1, -c2, n + 1) for n, (c1, c2, q, label, i) in enumerate(pairs[:9])}
    columns = ["person_id", "related_person", "entity_type", "entity_id", "conf1", "conf2", "rank"]
    got = [tuple(r) for r in G.shared_entities(edges, limit=9).select(*columns).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_row_a_candidate_is_sorted(spark):
    edges = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("from_id"), F.lit("Device").alias("to_label"),
                                     F.concat(F.lit("d"), F.col("id") % 3).alias("to_id"), F.lit(1.0).alias("confidence"))
    plan = G.shared_entities(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window.*related_person", plan)
    assert G.shared_entities(edges).count() == 50_000
