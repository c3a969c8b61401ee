"""Identity graph kept as two DataFrames.

``nodes(label, id)`` and ``edges(rel_type, from_label, from_id, to_label,
to_id, timestamp_start, timestamp_end, confidence, total_amount, tx_count,
last_timestamp, last_event_time)``.  Every edge goes from a Person to one
entity.  All operators are set-based joins and aggregations; per-entity
top-k uses ``row_number() <= k``, which Spark evaluates with a partial
group limit before the shuffle, so hub entities do not land in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from .skew import hot_keys, is_broadcast, salted_join

EDGE_KEY = ["rel_type", "from_label", "from_id", "to_label", "to_id"]
OPEN_END_TEXT = "9999-12-31T23:59:59Z"
#: Parts of the seeds with their lists, for each shuffle partition.
LIST_PARTS = 8


def person_id(person_key: str = "transaction") -> Column:
    """Q6: one Person per transaction (default) or per national code."""
    if person_key == "transaction":
        return F.concat(F.col("transaction_id"), F.lit(config.PERSON_SUFFIX))
    if person_key == "national_code":
        return F.col("national_code")
    raise ValueError(person_key)


def graph_nodes(tx: DataFrame, person_key: str = "transaction") -> DataFrame:
    """Distinct (label, id) of the Person and its six entities, one scan."""
    pairs = [F.struct(F.lit("Person").alias("label"), person_id(person_key).alias("id"))]
    pairs += [F.struct(F.lit(label).alias("label"), F.col(col).alias("id")) for _, label, col in config.RELATIONS]
    return (tx.select(F.explode(F.array(*pairs)).alias("n")).select("n.label", "n.id")
              .filter(F.col("id").isNotNull()).distinct())


def graph_edge_events(tx: DataFrame, person_key: str = "transaction") -> DataFrame:
    """Six edge events per transaction; only USES_IP carries the IP
    confidence, the others 1.0."""
    pid = person_id(person_key)
    structs = []
    for rel, label, col in config.RELATIONS:
        conf = F.col("ip_confidence") if rel == "USES_IP" else F.lit(config.FULL_CONFIDENCE)
        structs.append(F.struct(F.lit(rel).alias("rel_type"), F.lit(label).alias("to_label"),
                                F.col(col).alias("to_id"), conf.cast("double").alias("confidence")))
    return (tx.select(pid.alias("from_id"), "event_time", "timestamp_utc", "transaction_id",
                      F.col("amount_rial").alias("amount"), F.explode(F.array(*structs)).alias("e"))
              .select(F.col("e.rel_type").alias("rel_type"), F.lit("Person").alias("from_label"), "from_id",
                      F.col("e.to_label").alias("to_label"), F.col("e.to_id").alias("to_id"),
                      F.col("e.confidence").alias("confidence"), "amount", "event_time", "timestamp_utc",
                      "transaction_id")
              .filter(F.col("to_id").isNotNull() & F.col("from_id").isNotNull()))


def aggregate_edge_events(events: DataFrame) -> DataFrame:
    """A5: per edge key within one batch: first/last by (event_time, id)
    order, summed amount, count.  Partial aggregation makes hub keys cheap."""
    order = F.struct("event_time", "transaction_id")
    return (events.groupBy(*EDGE_KEY)
                  .agg(F.min_by("timestamp_utc", order).alias("timestamp_start"),
                       F.max_by("confidence", order).alias("confidence"),
                       F.sum("amount").cast("long").alias("total_amount"),
                       F.count(F.lit(1)).alias("tx_count"),
                       F.max_by("timestamp_utc", order).alias("last_timestamp"),
                       F.max("event_time").alias("last_event_time"))
                  .withColumn("timestamp_end", F.lit(OPEN_END_TEXT)))


EDGE_COLUMNS = EDGE_KEY + ["timestamp_start", "timestamp_end", "confidence", "total_amount", "tx_count",
                           "last_timestamp", "last_event_time"]


def graph_edges(tx: DataFrame, person_key: str = "transaction") -> DataFrame:
    """U2 + A5: the edge table built from a set of transactions."""
    return aggregate_edge_events(graph_edge_events(tx, person_key)).select(*EDGE_COLUMNS)


def edges_with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep an edge only when both end nodes exist (two semi joins)."""
    src = nodes.select(F.col("label").alias("from_label"), F.col("id").alias("from_id"))
    dst = nodes.select(F.col("label").alias("to_label"), F.col("id").alias("to_id"))
    return (edges.join(src, on=["from_label", "from_id"], how="left_semi")
                 .join(dst, on=["to_label", "to_id"], how="left_semi"))


def merge_nodes(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Insert (label, id) pairs that are absent; empty delta is a no-op."""
    d = delta.select("label", "id").dropDuplicates(["label", "id"])
    if state is None:
        return d
    new = d.join(state.select("label", "id"), on=["label", "id"], how="left_anti")
    return state.select("label", "id").unionByName(new)


def merge_edges(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Upsert aggregated delta edges into the state by edge key.

    First timestamp is kept, end is open, confidence and last timestamp come
    from the delta, amount and count are added."""
    d = delta.select(*EDGE_COLUMNS)
    if state is None:
        return d
    s = state.select(*EDGE_COLUMNS)
    sa = s.select(*EDGE_KEY, *[F.col(c).alias("s_" + c) for c in EDGE_COLUMNS if c not in EDGE_KEY])
    da = d.select(*EDGE_KEY, *[F.col(c).alias("d_" + c) for c in EDGE_COLUMNS if c not in EDGE_KEY])
    j = sa.join(da, on=EDGE_KEY, how="full_outer")
    return j.select(
        *EDGE_KEY,
        F.coalesce("s_timestamp_start", "d_timestamp_start").alias("timestamp_start"),
        F.lit(OPEN_END_TEXT).alias("timestamp_end"),
        F.coalesce("d_confidence", "s_confidence").alias("confidence"),
        (F.coalesce("s_total_amount", F.lit(0)) + F.coalesce("d_total_amount", F.lit(0))).cast("long")
        .alias("total_amount"),
        (F.coalesce("s_tx_count", F.lit(0)) + F.coalesce("d_tx_count", F.lit(0))).cast("long").alias("tx_count"),
        F.coalesce("d_last_timestamp", "s_last_timestamp").alias("last_timestamp"),
        F.coalesce("d_last_event_time", "s_last_event_time").alias("last_event_time"),
    )


def ingest_batch(nodes: DataFrame | None, edges: DataFrame | None, tx: DataFrame,
                 person_key: str = "transaction") -> tuple[DataFrame, DataFrame]:
    """One batch of normalised transactions into the graph state."""
    new_nodes = merge_nodes(nodes, graph_nodes(tx, person_key))
    delta = edges_with_endpoints(graph_edges(tx, person_key), new_nodes)
    return new_nodes, merge_edges(edges, delta)


def _entity_edges(edges: DataFrame) -> DataFrame:
    """P5: only edges that point at one of the six entity labels."""
    return edges.filter(F.col("to_label").isin(config.ENTITY_LABELS))


def identity_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Per Person the distinct connected entities (depth 1).

    An unknown person yields no row; a person without edges an empty list."""
    persons = nodes.filter(F.col("label") == "Person").select(F.col("id").alias("person_id"))
    if seeds is not None:
        persons = persons.join(seeds.select("person_id").distinct(), "person_id", "left_semi")
    e = _entity_edges(edges).select(
        F.col("from_id").alias("person_id"),
        F.struct(F.col("to_label").alias("type"), F.col("to_id").alias("id"),
                 F.col("confidence").alias("confidence"), F.col("tx_count").alias("tx_count"),
                 F.col("last_timestamp").alias("last_ts")).alias("entity"))
    j = persons.join(e, "person_id", "left")
    return (j.groupBy("person_id")
             .agg(F.sort_array(F.collect_set("entity")).alias("entities")))


def shared_entities(edges: DataFrame, seeds: DataFrame | None = None,
                    limit: int = config.SHARED_LIMIT,
                    min_confidence: float = config.SHARED_MIN_CONFIDENCE) -> DataFrame:
    """J5 + K2: persons sharing an entity with each seed person.

    Both edges need confidence >= ``min_confidence`` (P6, pushed below the
    joins).  Order: conf1 desc, conf2 desc, then related person, entity type,
    entity id; ``limit`` rows per seed (the reported list).

    No pair list is built: for every entity only its best ``limit + 1``
    persons (by conf2 desc, id) can appear in any seed's answer, so those are
    selected per entity first (partial top-k before the shuffle, so a hub
    device or IP costs ``limit + 1`` rows per map task) and kept as one list.
    A seed's edge takes its entity's list along, one row an edge, to the seed,
    where the best of its lists are picked: no row a candidate is shuffled or
    sorted.  The seeds of a hub entity are dealt over salts.
    """
    e = (_entity_edges(edges).filter(F.col("confidence") >= min_confidence)
         .select(F.col("from_id").alias("person_id"), "to_label", "to_id", "confidence"))
    seed_edges = e if seeds is None else e.join(
        seeds.select("person_id").distinct(), "person_id", "left_semi")
    seed_edges = seed_edges.select(F.col("person_id"), "to_label", "to_id", F.col("confidence").alias("conf1"))
    entity = ["to_label", "to_id"]
    per_entity = Window.partitionBy(*entity).orderBy(F.col("confidence").desc(), F.col("person_id"))
    best = (e.withColumn("_r", F.row_number().over(per_entity))
             .filter(F.col("_r") <= limit + 1))
    # confidences negated, so that all orders rise; persons of one confidence together
    runs = best.groupBy(*entity, (-F.col("confidence")).alias("low2")).agg(F.sort_array(F.collect_list("person_id")).alias("persons"))
    lists = runs.groupBy(*entity).agg(F.collect_list(F.struct("low2", "persons")).alias("runs"))
    hot = {} if is_broadcast(e) else hot_keys(seed_edges, {"entity": entity})["entity"]
    # lists shrink well in a shuffle but not in memory: smaller parts than Spark would make of them
    parts = LIST_PARTS * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = salted_join(seed_edges, lists, entity, hot, "inner").repartition(parts, "person_id")
    owned = linked.groupBy("person_id").agg(F.collect_list(F.struct("conf1", *entity, "runs")).alias("edges"))

    def own_runs(edge):
        return F.transform(edge["runs"], lambda run: F.struct(
            (-edge["conf1"]).alias("low1"), run["low2"], edge["to_label"].alias("entity_type"), edge["to_id"].alias("entity_id"),
            F.array_remove(run["persons"], F.col("person_id")).alias("persons")))

    top = _let(F.sort_array(F.flatten(F.transform("edges", own_runs))), lambda runs: _best_of_runs(runs, limit))
    return (owned.select("person_id", F.posexplode(top).alias("_pos", "_c"))
                 .select("person_id", "_c.related_person", "_c.entity_type", "_c.entity_id", (-F.col("_c.low1")).alias("conf1"),
                         (-F.col("_c.low2")).alias("conf2"), (F.col("_pos") + 1).alias("rank")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _best_of_runs(runs: Column, limit: int) -> Column:
    """The first ``limit`` candidates of sorted runs (low1, low2, entity, sorted
    persons), in order.  The level (low1, low2) in which the last of them lies is
    found from the sizes, then the last person wanted of that level; only
    candidates up to there become rows."""
    def before(run, end):
        return (run["low1"] < end["low1"]) | ((run["low1"] == end["low1"]) & (run["low2"] < end["low2"]))

    def level(run, end):
        return (run["low1"] == end["low1"]) & (run["low2"] == end["low2"])

    def step(n, low1, low2):
        return F.struct(n.cast("int").alias("n"), low1.cast("double").alias("low1"), low2.cast("double").alias("low2"))

    def reach(so_far, run):
        n = so_far["n"] + F.size(run["persons"])
        return F.when(so_far["n"] >= limit, so_far).when(n >= limit, step(n, run["low1"], run["low2"])).otherwise(
            step(n, so_far["low1"], so_far["low2"]))

    def last_person(end):
        earlier = F.aggregate(F.filter(runs, lambda r: before(r, end)), F.lit(0), lambda n, r: n + F.size(r["persons"]))
        persons = F.flatten(F.transform(F.filter(runs, lambda r: level(r, end)), lambda r: r["persons"]))
        return F.get(F.sort_array(persons), F.lit(limit - 1) - earlier)

    def rows(end, last):
        def of(run):
            persons = F.when(before(run, end), run["persons"]).when(level(run, end), F.filter(run["persons"], lambda p: p <= last))
            return F.transform(F.coalesce(persons, F.array().cast("array<string>")), lambda p: F.struct(
                run["low1"].alias("low1"), run["low2"].alias("low2"), p.alias("related_person"),
                run["entity_type"].alias("entity_type"), run["entity_id"].alias("entity_id")))
        return F.slice(F.sort_array(F.flatten(F.transform(runs, of))), 1, limit)

    everything = F.lit(float("inf"))
    end = F.aggregate(runs, step(F.lit(0), everything, everything), reach)
    return _let(end, lambda e: _let(last_person(e), lambda last: rows(e, last)))


def high_risk_ips(edges: DataFrame, min_cards: int = config.HIGH_RISK_MIN_CARDS,
                  n: int = config.HIGH_RISK_LIMIT) -> DataFrame:
    """J6 + A7 + K3: IPs used by persons owning at least ``min_cards``
    distinct cards; top ``n`` by distinct cards (ties by IP)."""
    ip = edges.filter(F.col("rel_type") == "USES_IP").select(F.col("from_id").alias("p"),
                                                              F.col("to_id").alias("ip_address"))
    card = edges.filter(F.col("rel_type") == "OWNS_CARD").select(F.col("from_id").alias("p"),
                                                                  F.col("to_id").alias("card"))
    g = (ip.join(card, "p").groupBy("ip_address")
           .agg(F.countDistinct("card").alias("unique_cards"), F.countDistinct("p").alias("unique_persons"))
           .filter(F.col("unique_cards") >= min_cards))
    return g.orderBy(F.col("unique_cards").desc(), F.col("ip_address")).limit(n)


def cleanup_old_nodes(nodes: DataFrame, edges: DataFrame, as_of: str,
                      days: int = config.CLEANUP_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop IP and Device nodes without a use newer than ``as_of - days``
    and detach their edges.  Returns (nodes, edges, deleted counts by label).

    Recency is compared on the event time (the intent of the reproduced
    code; see SURVEY Q7)."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = (edges.filter(F.col("rel_type").isin("USES_IP", "USES_DEVICE") &
                           (F.col("last_event_time") > cutoff))
                   .select(F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct())
    target = nodes.filter(F.col("label").isin("IP", "Device"))
    doomed = target.join(recent, ["label", "id"], "left_anti")
    kept_nodes = nodes.join(doomed, ["label", "id"], "left_anti")
    kept_edges = (edges.join(doomed.select(F.col("label").alias("to_label"), F.col("id").alias("to_id")),
                             ["to_label", "to_id"], "left_anti"))
    counts = doomed.groupBy("label").agg(F.count(F.lit(1)).alias("deleted"))
    return kept_nodes, kept_edges, counts


# ------------------------------------------------------------------ storage

def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int) -> None:
    """Write version ``version`` of the graph (nodes by label, edges by
    relation type).  Versions are never updated in place."""
    base = f"{path.rstrip('/')}/v={int(version):08d}"
    nodes.write.mode("overwrite").partitionBy("label").parquet(base + "/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(base + "/edges")


def read_graph(spark, path: str, version: int) -> tuple[DataFrame, DataFrame]:
    base = f"{path.rstrip('/')}/v={int(version):08d}"
    return spark.read.parquet(base + "/nodes"), spark.read.parquet(base + "/edges")
