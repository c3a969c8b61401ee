"""Ingestion: validate, normalise and split raw transactions.

One narrow projection: no shuffle, everything inside whole-stage codegen.
Invalid rows are kept in the same DataFrame with their error text, and
``split`` yields the clean and the dead-letter side as two filters over it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import identity as FI
from ..functions import network as FN
from ..functions import timeparse as FT
from ..functions.format import sha256_hex

# Raw transaction fields: (name, kind, required). kind is "str" or "int".
RAW_FIELDS = [
    ("transaction_id", "str", True),
    ("timestamp", "str", True),
    ("amount_rial", "int", True),
    ("card_pan", "str", True),
    ("account_number", "str", True),
    ("national_code", "str", True),
    ("mobile", "str", True),
    ("ip_address", "str", True),
    ("device_fingerprint", "str", True),
    ("user_agent", "str", False),
    ("channel", "str", False),
    ("result", "str", False),
]

# Every value is read as text so that type checks can report errors instead of
# silently nulling a field.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n, _, _ in RAW_FIELDS])

NORMALIZED_COLUMNS = [
    "transaction_id", "timestamp_utc", "timestamp_local", "amount_rial", "card_pan",
    "card_pan_masked", "account_number", "national_code", "mobile_e164", "mobile_normalized",
    "ip_address", "is_carrier_nat", "ip_confidence", "device_fingerprint", "device_fp_hash",
    "user_agent", "channel", "result", "ingested_at", "is_night",
]


def parse_payloads(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """JSON text -> raw text fields plus ``_keys`` (present keys) and ``_json_ok``."""
    p = F.col(payload_col)
    parsed = F.from_json(p, RAW_TEXT_SCHEMA)
    keys = F.json_object_keys(p)
    return df.select(
        p.alias("raw_payload"),
        parsed.alias("_r"),
        keys.alias("_keys"),
    ).select("raw_payload", "_keys", F.col("_keys").isNotNull().alias("_json_ok"), "_r.*")


def _loc(name: str) -> str:
    return "('" + name + "',): "


def _value_error(name: str, msg: Column) -> Column:
    return F.concat(F.lit(_loc(name) + "Value error, "), msg)


def _is_int_text(c: Column) -> Column:
    # JSON integers, or JSON numbers with a zero fraction (accepted as int).
    return c.rlike(r"^-?[0-9]+(\.0*)?$")


def amount_value(c: Column) -> Column:
    """Integer value of an amount given as text, NULL when it is not an integer."""
    return F.when(_is_int_text(c), F.regexp_extract(c, r"^(-?[0-9]+)", 1).try_cast("long"))


def _stage(df: DataFrame) -> DataFrame:
    """Shared intermediate columns, each computed once per row."""
    out = df
    if "amount_rial" in out.columns:
        out = out.withColumn("_amt_s", F.col("amount_rial").cast("string"))
    return (out
            .withColumn("_ts_s", FN.strip_ws(F.col("timestamp")) if "timestamp" in out.columns
                        else F.lit(None).cast("string"))
            .withColumn("_card_d", FI.digits_only(F.col("card_pan")))
            .withColumn("_nc_d", FI.digits_only(F.col("national_code")))
            .withColumn("_ip_s", FN.strip_ws(F.col("ip_address")))
            .withColumn("_mob_f", FI.mobile_folded(F.col("mobile"))))


def field_errors(df: DataFrame) -> Column:
    """P1a-P1d, P1f: every field error in field order (array<string>).
    Expects the staged columns of ``_stage`` plus ``_amt``, ``_nc_ok``, ``_ip_ok``."""
    errs = []
    has_keys = "_keys" in df.columns
    for name, kind, required in RAW_FIELDS:
        if name not in df.columns:
            continue
        v = F.col(name)
        present = F.coalesce(F.array_contains(F.col("_keys"), name), F.lit(True)) if has_keys else F.lit(True)
        type_msg = ("Input should be a valid integer, unable to parse string as an integer"
                    if kind == "int" else "Input should be a valid string")
        if not required:
            continue
        e = F.when(~present, F.lit(_loc(name) + "Field required")).when(v.isNull(), F.lit(_loc(name) + type_msg))
        if kind == "int":
            amt = F.col("_amt")
            e = (e.when(amt.isNull(), F.lit(_loc(name) + type_msg))
                  .when(amt <= 0, _value_error(name, F.lit("مبلغ باید مثبت باشه")))
                  .when(amt > config.MAX_AMOUNT_RIAL,
                        _value_error(name, F.concat(F.lit("مبلغ غیرمعقول: "), amt.cast("string")))))
        elif name == "card_pan":
            d = F.col("_card_d")
            e = e.when(F.length(d) != 16, _value_error(name, FI.card_error(d)))
        elif name == "national_code":
            d = F.col("_nc_d")
            e = e.when((F.length(d) != 10) | ~F.col("_nc_ok"),
                       _value_error(name, FI.national_code_error(d, F.col("_nc_ok"))))
        elif name == "ip_address":
            e = e.when(~F.col("_ip_ok"), _value_error(name, F.concat(F.lit("IP نامعتبر: "), v)))
        errs.append(e)
    return F.filter(F.array(*errs), lambda x: x.isNotNull())


def blank_error() -> Column:
    """P1e: the first required field that is blank (checked after field rules).
    Validated fields are checked in their cleaned form."""
    cleaned = {"card_pan": "_card_d", "national_code": "_nc_d", "ip_address": "_ip_s"}
    e = None
    for name in config.REQUIRED_NON_EMPTY:
        v = F.col(cleaned.get(name, name))
        blank = v.isNull() | (FN.strip_ws(v) == "")
        msg = F.lit("(): Value error, فیلد اجباری خالیه: " + name)
        e = F.when(blank, msg) if e is None else e.when(blank, msg)
    return e


def validate(df: DataFrame) -> DataFrame:
    """Adds ``error`` (NULL for valid rows) and the parsed ``event_time``.

    Field errors are all reported, joined by '; ', behind ``ValidationError: ``.
    The blank-field check runs only when the fields themselves are valid.
    A timestamp no layout can read is an ``UnexpectedError``.

    Built in stages of narrow projections so that every shared value (digits,
    checksum, parsed time) is computed once per row; the last stage carries a
    partition tag, which keeps row-routing filters from being pushed below it
    and re-evaluating the whole validation inside the filter.
    """
    s1 = _stage(df)
    s2 = (s1.withColumn("_amt", amount_value(F.col("_amt_s")))
            .withColumn("_nc_ok", FI.national_code_valid(F.col("_nc_d")))
            .withColumn("_ip_ok", FN.ipv4_valid(F.col("_ip_s")) | FN.ipv6_valid(F.col("_ip_s")))
            .withColumn("event_time", FT.parse_event_time(F.col("_ts_s"), stripped=True)))
    s3 = s2.withColumn("_fe", field_errors(s2)).withColumn("_blank", blank_error())
    err = (F.when(F.size("_fe") > 0, F.concat(F.lit("ValidationError: "), F.array_join("_fe", "; ")))
            .when(F.col("_blank").isNotNull(), F.concat(F.lit("ValidationError: "), F.col("_blank")))
            .when(F.col("event_time").isNull(),
                  F.concat(F.lit("UnexpectedError: نمی‌تونم timestamp رو parse کنم: "), F.col("timestamp"))))
    if "_json_ok" in df.columns:
        err = F.when(~F.col("_json_ok"), F.lit("UnexpectedError: payload is not a JSON object")).otherwise(err)
    return (s3.withColumn("error", err).drop("_fe", "_blank")
              .withColumn("_part", F.spark_partition_id()))


def normalize_fields(df: DataFrame, event_time: Column | None = None) -> DataFrame:
    """The 20 normalised columns (+ ``event_time``) from raw text fields.

    ``event_time`` may be passed in when the instant is already known (clean
    sources); otherwise it is parsed from ``timestamp``.  Staged columns from
    ``validate`` are reused when present.
    """
    src = df if "_card_d" in df.columns else _stage(df)
    if event_time is not None:
        src = src.withColumn("event_time", event_time)
    elif "event_time" not in src.columns:
        src = src.withColumn("event_time", FT.parse_event_time(F.col("_ts_s"), stripped=True))
    if "_amt" not in src.columns:
        src = src.withColumn("_amt", amount_value(F.col("_amt_s")))
    src = src.withColumn("_nat", FN.is_carrier_nat(F.col("_ip_s")))
    passthrough = [c for c in df.columns if c in ("user_id", "event_id", "account_type")]
    return src.select(
        *passthrough,
        "event_time",
        F.col("transaction_id"),
        FT.utc_text(F.col("event_time")).alias("timestamp_utc"),
        FT.local_text(F.col("event_time")).alias("timestamp_local"),
        F.col("_amt").alias("amount_rial"),
        F.col("_card_d").alias("card_pan"),
        FI.mask_card(F.col("_card_d")).alias("card_pan_masked"),
        F.col("account_number"),
        F.col("_nc_d").alias("national_code"),
        FI.normalize_mobile_e164(F.col("mobile"), F.col("_mob_f")).alias("mobile_e164"),
        FI.normalize_mobile_national(F.col("mobile"), F.col("_mob_f")).alias("mobile_normalized"),
        F.col("_ip_s").alias("ip_address"),
        F.col("_nat").alias("is_carrier_nat"),
        FN.ip_confidence(F.col("_nat")).alias("ip_confidence"),
        F.col("device_fingerprint"),
        sha256_hex(F.col("device_fingerprint")).alias("device_fp_hash"),
        F.col("user_agent").cast("string").alias("user_agent"),
        F.col("channel").cast("string").alias("channel"),
        F.col("result").cast("string").alias("result"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"),
        FT.is_night(F.col("event_time")).alias("is_night"),
    )


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate, normalise and split raw rows: returns (clean, dead-letter)."""
    return split(validate(raw))


def route(validated: DataFrame, valid: bool) -> DataFrame:
    """Rows that passed (``valid=True``) or failed validation.

    The predicate also reads the partition tag set by ``validate``; a
    projection holding a non-deterministic column is not crossed by predicate
    push-down, so the validation is evaluated once, below the filter."""
    cond = F.col("error").isNull() if valid else F.col("error").isNotNull()
    if "_part" in validated.columns:
        cond = cond & (F.col("_part") >= 0)
    return validated.filter(cond)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, dead-letter) from a validated frame."""
    v = df if "error" in df.columns else validate(df)
    clean = normalize_fields(route(v, True), event_time=F.col("event_time"))
    dlq = dead_letters(v)
    return clean, dlq


def dead_letters(validated: DataFrame, source: str = config.DLQ_SOURCE) -> DataFrame:
    """S5 record: raw payload, error, failed_at, source."""
    v = validated
    if "raw_payload" not in v.columns:
        fields = [n for n, _, _ in RAW_FIELDS if n in v.columns]
        v = v.withColumn("raw_payload", F.to_json(F.struct(*fields)))
    return (route(v, False)
             .select(F.col("transaction_id"), F.col("raw_payload"), F.col("error"),
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("failed_at"),
                     F.lit(source).alias("source")))


def ingest_stats(validated: DataFrame) -> DataFrame:
    """Ok / dlq counts of one batch (one row)."""
    return validated.agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("dlq"),
        F.lit(1).cast("long").alias("batches"))


def high_water_mark(clean: DataFrame, since: str | None = None) -> DataFrame:
    """Next ``since`` = max ``timestamp_utc`` of the valid rows, never
    moving backwards (``greatest`` with the previous mark)."""
    m = F.max("timestamp_utc")
    if since is not None:
        m = F.greatest(F.coalesce(m, F.lit(since)), F.lit(since))
    return clean.agg(m.alias("high_water_mark"))


def incremental(clean: DataFrame, since: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows after the cursor ``since`` = (timestamp_utc,
    transaction_id) of the last row seen.  Many rows share a second, so the
    time alone would lose those of a page's last second.  With ``limit`` the
    first so many in this order and all rows that tie with the last of them,
    as ids may be delivered again: a page; walk on from its last row."""
    out = clean
    if since is not None:
        time, tid = F.col("timestamp_utc"), F.col("transaction_id")
        out = clean.filter((time > since[0]) | ((time == since[0]) & (tid > since[1])))
    if limit is not None:
        order = ["timestamp_utc", "transaction_id"]
        last = out.select(F.struct(*order).alias("last")).orderBy("last").limit(limit).agg(F.max("last").alias("last"))
        out = out.join(F.broadcast(last), F.struct(*order) <= F.col("last")).drop("last").orderBy(*order)
    return out


#: Rows of a file of the clean table: a file is read by one task.
CLEAN_FILE_ROWS = 65_536


def write_clean_table(clean: DataFrame, path: str) -> None:
    """Persist normalised transactions (parquet; ``ingested_at`` is the
    time of this write), in files small enough to spread the work of readers."""
    clean.write.mode("overwrite").option("maxRecordsPerFile", CLEAN_FILE_ROWS).parquet(path)
