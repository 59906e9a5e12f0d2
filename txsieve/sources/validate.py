"""Canonical form of raw rows, the rules they must meet, and the split into accepted and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsieve.schema import CANONICAL, LISTS

REQUIRED = ("event_id", "txid", "timestamp", "src_ip", "dst_ip")


def text_list(c: str, pipes: bool) -> Column:
    """A list of strings from a pipe-separated text, or as it is; null and blank are empty."""
    empty = F.array().cast("array<string>")
    if not pipes:
        return F.coalesce(F.col(c).cast("array<string>"), empty)
    return bound(F.col(c), lambda t: F.when(F.coalesce(F.trim(t), F.lit("")) == "", empty).otherwise(F.split(t, r"\|")))


def bound(x: Column, f) -> Column:
    """f(x), where x is computed once however often f names it, also in a filter that Spark moves below what makes x."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def instant(c: Column) -> Column:
    """ISO text (UTC unless it says otherwise) or seconds since 1970."""
    zoned = c.rlike(r"(?i)(z|utc|gmt|[+-][0-9]{1,2}(:?[0-9]{2})?|[a-z]+/[a-z_]+)\s*$") & c.contains(":")
    plain = F.try_to_timestamp(F.when(~zoned, F.concat(c, F.when(c.contains(":"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))))
    return F.coalesce(F.try_to_timestamp(F.when(zoned, c)), plain, F.timestamp_seconds(number(c)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(c: Column) -> Column:
    """A finite number, or null: NaN and infinities are none."""
    return finite(c.try_cast("double"))


def numbers(texts: Column) -> Column:
    """number() of each text of a list; each is read once."""
    return F.transform(F.transform(texts, lambda c: c.try_cast("double")), finite)


def canonicalize(raw: DataFrame, batch_id: str = "batch_canonical") -> DataFrame:
    """Raw rows (text, or lists) with canonical columns beside: ``raw`` keeps the whole row as JSON, ``reasons`` why it fails."""
    kinds = dict(raw.dtypes)
    for name in (f.name for f in CANONICAL if f.name not in ("source_batch_id", "ingest_time")):
        if name not in kinds:
            raw = raw.withColumn(name, F.lit(None).cast("array<string>" if name in LISTS else "string"))
    kinds = dict(raw.dtypes)
    df = raw.select(F.to_json(F.struct(*raw.columns)).alias("raw"), "*")
    lists = {c: text_list(c, not kinds[c].startswith("array")) for c in LISTS}
    text = lambda c: bound(F.trim(F.col(c).cast("string")), lambda t: F.nullif(t, F.lit("")))
    amounts = {c: numbers(lists[c]) for c in ("input_amounts", "output_amounts")}
    broken = {
        # an event without an id is named by its txid
        **{f"{c} is missing": (F.coalesce(text(c), text("txid")) if c == "event_id" else text(c)).isNull() for c in REQUIRED},
        "timestamp is not a time": bound(text("timestamp"), lambda t: t.isNotNull() & instant(t).isNull()),
        **{f"{c} is not a port": ~F.coalesce(text(c).try_cast("int").between(0, 65535), F.lit(False)) for c in ("src_port", "dst_port")},
        "fee is not a number of at least 0": ~F.coalesce(bound(text("fee"), number) >= 0, F.lit(False)),
        **{f"{c} has a value that is no number of at least 0": F.exists(amounts[c], lambda x: x.isNull() | (x < 0)) for c in amounts},
    }
    reasons = F.filter(F.array(*[F.when(cond, F.lit(why)) for why, cond in broken.items()]), lambda x: x.isNotNull())
    return df.select(
        "raw", reasons.alias("reasons"),
        F.coalesce(text("event_id"), F.concat(F.lit("evt_"), text("txid"))).alias("event_id"), text("txid").alias("txid"), bound(text("timestamp"), instant).alias("timestamp"),
        text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"), text("src_port").try_cast("int").alias("src_port"), text("dst_port").try_cast("int").alias("dst_port"),
        lists["input_addresses"].alias("input_addresses"), lists["output_addresses"].alias("output_addresses"),
        amounts["input_amounts"].alias("input_amounts"), amounts["output_amounts"].alias("output_amounts"), bound(text("fee"), number).alias("fee"),
        text("script_type").alias("script_type"), text("geo_country").alias("geo_country"), text("asn").alias("asn"),
        F.lit(batch_id).alias("source_batch_id"), F.current_timestamp().alias("ingest_time"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).select(*[F.col(f.name).cast(f.dataType) for f in CANONICAL])


def quarantined(checked: DataFrame) -> DataFrame:
    """batch_id, raw_data, error_reason, timestamp of the rows that fail."""
    return checked.where(F.size("reasons") > 0).select(
        F.col("source_batch_id").alias("batch_id"), F.col("raw").alias("raw_data"), F.array_join("reasons", "; ").alias("error_reason"), F.col("ingest_time").alias("timestamp")
    )


def manifest(checked: DataFrame, run_id: str) -> DataFrame:
    """One row: counts, status and times of a run."""
    ok = F.size("reasons") == 0
    return checked.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"),
        F.min("ingest_time").alias("started_at"), F.max("ingest_time").alias("finished_at"),
    ).select(
        F.lit(run_id).alias("run_id"), "*",
        F.when(F.col("received") == 0, "EMPTY").when(F.col("quarantined") > 0, "COMPLETED_WITH_QUARANTINE").otherwise("COMPLETED").alias("status"),
    )


def check_source(raw: DataFrame, required=("txid", "timestamp")) -> None:
    """A source must have the required columns and a row."""
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if raw.isEmpty():
        raise ValueError("the source has no rows")


def check_upload(spark: SparkSession, path: str) -> None:
    """A CSV source has the extension, some text, valid UTF-8, a header with the required columns, and a row.

    One pass over the lines; only counts come to the driver.
    """
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("only CSV sources are taken")
    found = spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("lines"), F.count_if(~F.is_valid_utf8("value")).alias("bad")).first()
    if found.bad:
        raise ValueError(f"{found.bad} lines are not valid UTF-8")
    if not found.lines:
        raise ValueError("the source is empty")
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if not any(c.strip() and not c.startswith("_c") for c in raw.columns):
        raise ValueError("the source has no header")
    check_source(raw)


def first_per_txid(df: DataFrame) -> DataFrame:
    """The first row of each txid in order; blank txids are left out."""
    w = Window.partitionBy("txid").orderBy("timestamp", "event_id")
    return df.where(F.trim(F.coalesce("txid", F.lit(""))) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


RAW_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in CANONICAL if f.name not in ("source_batch_id", "ingest_time")])
RAW_LIST_SCHEMA = T.StructType(
    [T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in LISTS else T.StringType()) for f in CANONICAL if f.name not in ("source_batch_id", "ingest_time")]
)
