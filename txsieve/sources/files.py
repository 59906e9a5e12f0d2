"""Readers and writers: CSV, JSON, XML and Parquet. Fields are read as text and cast later; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txsieve.schema import CANONICAL, LISTS, RAW

from .validate import RAW_LIST_SCHEMA, RAW_SCHEMA, accepted, canonicalize, manifest, quarantined


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, columns by name, lists as a|b|c."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.col(c).cast("string") for c in raw.columns])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of objects per file, or an object per line (splittable, for large inputs)."""
    return spark.read.option("multiLine", not lines).schema(RAW_LIST_SCHEMA).json(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "transaction").schema(RAW_SCHEMA).load(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Canonical Parquet; pruned columns and filters reach the scan."""
    return spark.read.schema(CANONICAL).parquet(path)


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml, "parquet": read_parquet}


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw rows of a source; the format is the extension if none is given."""
    kind = (fmt or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in READERS:
        raise ValueError(f"unknown source format {kind!r}")
    return READERS[kind](spark, path)


def select_canonical(df: DataFrame, columns=("txid", "src_ip", "fee")) -> DataFrame:
    return df.select(*columns)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels by txid; of repeated txids the last line stays."""
    raw = spark.read.option("header", True).csv(path).withColumn("_at", F.monotonically_increasing_id())
    last = Window.partitionBy("txid").orderBy(F.desc("_at"))
    return raw.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_at").withColumn("is_benign", F.lower(F.trim("is_benign")).isin("true", "1"))


def ingest(spark: SparkSession, path: str, batch_id: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, quarantined, manifest) of a source; bad rows never stop a batch."""
    checked = canonicalize(read_transactions(spark, path, fmt), batch_id)
    return accepted(checked), quarantined(checked), manifest(checked, batch_id)


def write_canonical(df: DataFrame, path: str, mode: str = "append") -> None:
    df.withColumn("day", F.to_date("timestamp")).write.mode(mode).partitionBy("day").parquet(path)


def write_quarantine(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_manifest(df: DataFrame) -> DataFrame:
    """The last row of each run: what an upsert by run_id would have left."""
    w = Window.partitionBy("run_id").orderBy(F.desc("finished_at"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = lambda t: t.startswith(("array", "struct", "map"))
    return df.select(*[F.to_json(c).alias(c) if nested(t) else F.col(c) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def amount_text(x: Column) -> Column:
    """Up to eight decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), r"0+$", ""), r"\.$", "")


def as_raw(df: DataFrame) -> DataFrame:
    """Canonical rows as text, lists joined by pipes: what the readers take."""
    def text(c):
        if c == "timestamp":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if c in ("input_amounts", "output_amounts"):
            return F.array_join(F.transform(c, amount_text), "|")
        return F.array_join(c, "|") if c in LISTS else amount_text(F.col(c)) if c == "fee" else F.col(c).cast("string")

    return df.select(*[text(c).alias(c) for c in RAW])


def write_transactions(df: DataFrame, path: str, fmt: str) -> None:
    """CSV, JSON or XML that the readers take back."""
    raw = as_raw(df)
    if fmt == "csv":
        raw.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        lists = {c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) for c in LISTS}
        raw.withColumns(lists).write.mode("overwrite").json(path)
    elif fmt == "xml":
        raw.write.mode("overwrite").format("xml").option("rootTag", "transactions").option("rowTag", "transaction").save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
