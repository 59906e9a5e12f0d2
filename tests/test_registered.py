"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from txsieve.operators import alerts
from txsieve.plans import feeds, queries, rough

DATA = "/root/testdata/sf0.001"
NAMES = ["val_rules", "val_manifest", "src_csv", "src_xml", "snk_export_csv", "st_ingest", "st_entity_state", "st_lineage", "st_lineage_hops", "st_late_rows", "st_windowed_counts", "b_node_attributes", "b_observed_ports", "x_related_entities", "x_graph_evidence"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r) for r in rows))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    made = (feeds.QUERIES | queries.QUERIES | rough.QUERIES)[name](spark, DATA)
    want = db.sql((feeds.ORACLE | queries.ORACLE | rough.ORACLE)[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    got = plain(made.select(*columns).collect())
    assert got and got == plain(want.select(*columns).fetchall())


def test_alert_ids_of_large_ranks(spark):
    df = spark.range(10012).select(
        F.col("id").cast("string").alias("event_id"), F.lit("t").alias("txid"), F.lit(0.5).alias("risk_score"), F.lit(0.5).alias("confidence_score"),
        F.lit(1).alias("signal_count"), F.array().cast("array<string>").alias("evidence"),
    )
    ranked = alerts.rank(df)
    assert ranked.select("alert_id").distinct().count() == 10012
    assert {r.alert_id for r in ranked.where("rank in (1, 10012)").collect()} == {"ALT_t_0001", "ALT_t_10012"}
