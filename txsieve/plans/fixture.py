"""Canonical transactions and labels derived from the test tables.

``events`` rows are transactions: users give addresses, ``lineitem`` rows are outputs. Time is
compressed forty times, so that short windows fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANOMALOUS = ("fan_in", "fan_out", "peeling_like", "mixing_like", "rapid_hop", "network_cluster")
START = 1704067200000000


#: The tables that the fixture is made from.
TABLES = ("events", "lineitem", "nation")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table; the one shuffle is the join of events and their lines by order key."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    address = F.concat(F.lit("a_"), (F.col("l_partkey") % 400).cast("string"))
    lines = (
        read("lineitem")
        .groupBy(F.col("l_orderkey").alias("event_id"))
        .agg(
            # what rows need of a line comes last: it follows from what they are sorted by, and no row has to map its lines
            F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", address.alias("address"), (F.col("l_extendedprice") / 10000).alias("amount")))).alias("lines"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
        )
    )
    nations = F.broadcast(read("nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name"))  # 25 rows
    e = read("events").join(lines, "event_id", "left").join(nations, F.col("user_id") % 25 == F.col("n"), "left")
    lines_ = F.coalesce(F.col("lines"), F.array().cast(e.schema["lines"].dataType))
    n = F.when(F.col("event_id") % 7 == 0, 1 + F.col("event_id") % 6).otherwise(1 + F.col("event_id") % 2)
    ts = F.expr(f"{START} + (unix_micros(cast(ts as timestamp)) - {START}) div 40")
    e = e.select(
        "*",
        F.when(F.col("event_type") == "purchase", F.array_repeat(F.lit(0.1), F.size(lines_))).otherwise(lines_["amount"]).alias("amounts"),
        (F.coalesce("tax", F.lit(0)).cast("double") / 10000).alias("fee_"),
        n.cast("int").alias("inputs"),
        ts.alias("us"),
        lines_.alias("lines_"),
    )
    spent = F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x) + F.col("fee_")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("tx_"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("txid"),
        F.timestamp_micros("us").alias("timestamp"),
        F.when(F.col("event_id") % 97 == 0, "unknown_ip")
        .otherwise(F.concat(F.lit("10.0."), (F.col("user_id") % 12).cast("string"), F.lit(".1")))
        .alias("src_ip"),
        F.concat(F.lit("172.16.0."), (F.col("event_id") % 4).cast("string")).alias("dst_ip"),
        (1024 + (F.col("user_id") * 7) % 300).cast("int").alias("src_port"),
        F.when(F.col("event_id") % 20 == 0, 18333).otherwise(8333).cast("int").alias("dst_port"),
        F.transform(
            F.sequence(F.lit(0), F.col("inputs") - 1),
            lambda i: F.concat(F.lit("a_"), ((F.col("user_id") * 3 + 17 * i) % 400).cast("string")),
        ).alias("input_addresses"),
        F.col("lines_")["address"].alias("output_addresses"),
        F.array_repeat(spent / F.col("inputs"), F.col("inputs")).alias("input_amounts"),  # summed up once, not for each input
        F.col("amounts").alias("output_amounts"),
        F.col("fee_").alias("fee"),
        F.col("event_type").alias("script_type"),
        F.col("n_name").alias("geo_country"),
        F.concat(
            F.lit("AS"), (100 * ((F.col("user_id") + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)) % 6)).cast("string")
        ).alias("asn"),
        F.lit("fixture").alias("source_batch_id"),
        F.timestamp_micros("us").alias("ingest_time"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    benign = F.col("event_type") != "error"
    kinds = F.array(*[F.lit(x) for x in ANOMALOUS])
    return e.select(
        F.concat(F.lit("tx_"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("txid"),
        F.when(benign, "benign").otherwise(F.get(kinds, (F.col("event_id") % 6).cast("int"))).alias("scenario"),
        benign.alias("is_benign"),
    )
