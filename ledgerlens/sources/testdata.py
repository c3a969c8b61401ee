"""Transactions derived from the driver tables (``events`` ⟕ ``customer``).

Every column is a deterministic function of an ``events`` row, so all work
grows with the table.  ``raw_transactions`` gives the raw, unvalidated field
values (with injected faults for the ingestion layer); ``transactions`` gives
clean normalised transactions ready for features, rules and the graph.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import PERSIAN_DIGITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _national_code(uid: Column) -> Column:
    """9-digit body ``user_id % 40 + 100000000`` plus its check digit."""
    body = (uid % 40 + 100000000).cast("string")
    s = sum((F.substring(body, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0)) % 11
    check = F.when(s < 2, s).otherwise(11 - s)
    return F.concat(body, check.cast("string"))


def account_types(customer: DataFrame) -> DataFrame:
    """Account dimension: customer key -> account type from the market segment."""
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "commercial")
         .when(F.col("c_mktsegment") == "MACHINERY", "vip")
         .otherwise("normal").alias("account_type"))


def clean_fields(events: DataFrame) -> DataFrame:
    """Raw transaction fields without faults (one row per event)."""
    uid = F.col("user_id")
    return events.select(
        F.col("user_id"),
        F.col("event_id"),
        F.concat(F.lit("TX-"), _lpad(F.col("event_id"), 8)).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.round(F.col("value") * 3000000).cast("long").alias("amount_rial"),
        F.concat(F.lit("603799"), _lpad((uid % 50) * 7919, 10)).alias("card_pan"),
        F.concat(F.lit("ACC-"), _lpad(uid % 30, 3)).alias("account_number"),
        _national_code(uid).alias("national_code"),
        F.concat(F.lit("912"), _lpad(uid, 7)).alias("mobile"),
        F.concat(F.when(uid % 10 == 0, F.lit("10.0.0.")).otherwise(F.lit("185.1.1.")),
                 (uid % 3).cast("string")).alias("ip_address"),
        F.concat(F.lit("fp-"), (uid % 5).cast("string")).alias("device_fingerprint"),
        F.lit(None).cast("string").alias("user_agent"),
        F.col("event_type").alias("channel"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("result"),
    )


def build_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean normalised transactions with ``account_type`` attached (J9 input),
    computed from the driver tables (no materialisation)."""
    from ..operators.ingest import normalize_fields
    from ..operators.enrich import attach_account_type

    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    fields = clean_fields(ev)
    tx = normalize_fields(fields, event_time=F.col("event_time"))
    tx = attach_account_type(tx, account_types(table(spark, sf_dir, "customer")), on="user_id")
    return tx


# --------------------------------------------------------------------------
# Raw payloads with faults, for the ingestion layer.
# --------------------------------------------------------------------------

# Text layouts used to write the raw timestamp, chosen by event_id % 6.
_RAW_LAYOUTS = [
    ("yyyy-MM-dd'T'HH:mm:ss", "local"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "utc"),
    ("yyyy-MM-dd'T'HH:mm:ss'+0330'", "local"),
    ("yyyy/MM/dd HH:mm:ss", "local"),
    ("yyyy-MM-dd HH:mm:ss", "local"),
    ("dd/MM/yyyy HH:mm:ss", "local"),
]


def raw_fields(events: DataFrame) -> DataFrame:
    """Raw field values with the faults of the ingestion fixture.

    event_id % 50 = 0 short card; % 53 amount -1; % 59 wrong check digit;
    % 61 bad IP; % 67 blank device; % 71 unparsable time; every 10th card
    written with dashes, every 13th with Persian digits; the time layout is
    chosen by event_id % 6.
    """
    base = clean_fields(events)
    eid = F.col("event_id")
    ts = F.col("event_time")
    local = F.from_utc_timestamp(ts, "Asia/Tehran")
    layout = eid % 6
    text = F.lit(None).cast("string")
    for i, (fmt, zone) in reversed(list(enumerate(_RAW_LAYOUTS))):
        text = F.when(layout == i, F.date_format(ts if zone == "utc" else local, fmt)).otherwise(text)
    card = F.col("card_pan")
    dashed = F.concat_ws("-", *[F.substring(card, 1 + 4 * k, 4) for k in range(4)])
    persian = F.translate(card, "0123456789", PERSIAN_DIGITS)
    card = (F.when(eid % 50 == 0, F.lit("12345"))
             .when(eid % 10 == 0, dashed)
             .when(eid % 13 == 0, persian)
             .otherwise(card))
    nc = F.col("national_code")
    bad_nc = F.concat(F.substring(nc, 1, 9),
                      ((F.substring(nc, 10, 1).cast("int") + 1) % 10).cast("string"))
    return base.select(
        "event_id", "transaction_id",
        F.when(eid % 71 == 0, F.lit("not-a-date")).otherwise(text).alias("timestamp"),
        F.when(eid % 53 == 0, F.lit(-1).cast("long")).otherwise(F.col("amount_rial")).alias("amount_rial"),
        card.alias("card_pan"),
        "account_number",
        F.when(eid % 59 == 0, bad_nc).otherwise(nc).alias("national_code"),
        "mobile",
        F.when(eid % 61 == 0, F.lit("999.999.0.1")).otherwise(F.col("ip_address")).alias("ip_address"),
        F.when(eid % 67 == 0, F.lit("  ")).otherwise(F.col("device_fingerprint")).alias("device_fingerprint"),
        "channel", "result",
    )


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per event: ``payload string`` (what a bank API returns)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    raw = raw_fields(ev)
    cols = [c for c in raw.columns if c != "event_id"]
    return raw.select(F.to_json(F.struct(*cols)).alias("payload"))


#: Changes whenever the normaliser or the table's files do, so that no older table is read back.
CLEAN_VERSION = "3"


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the normaliser and the source tables (path, sizes, times)."""
    import hashlib
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = [CLEAN_VERSION, sf_dir]
    for name in ("events", "customer"):
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        fs = p.getFileSystem(conf)
        for st in fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]:
            parts.append(f"{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:20]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean transaction table (S6), written once under the shared
    checkpoint folder and read back.  Downstream jobs then start from a plain
    parquet scan: their plans stay small and a lost executor re-reads the
    table instead of recomputing the normalisation lineage."""
    from ..operators.ingest import write_clean_table
    from ..session import scratch_path
    import uuid
    target = scratch_path(spark, f"clean-tx-{_fingerprint(spark, sf_dir)}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    tp = jvm.org.apache.hadoop.fs.Path(target)
    fs = tp.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")):
        tmp = f"{target}-{uuid.uuid4().hex}"
        write_clean_table(build_transactions(spark, sf_dir), tmp)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), tp):
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")):
                target = tmp
    return spark.read.parquet(target)


def end_of_data(tx: DataFrame) -> str | None:
    """The midnight after the newest event, as text (None: no events)."""
    end = F.date_trunc("day", F.max("event_time")) + F.expr("INTERVAL 1 DAY")
    return tx.agg(end.cast("string")).first()[0]
