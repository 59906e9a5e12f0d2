"""Lookups and screen-level queries over the result tables of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alerts import TIERS, filter_tier
from .detectors import FAMILY, SCORED


def alert_search(alerts: DataFrame, tier: str = "ALL", detector: str | None = None, text: str = "") -> DataFrame:
    """Tier, detector and a case-insensitive part of txid, alert id or detector; in rank order."""
    df = filter_tier(alerts, tier)
    if detector:
        df = df.where(F.array_contains("triggers", detector))
    if text:
        t = text.lower()
        has = F.lower("txid").contains(t) | F.lower("alert_id").contains(t) | F.exists("triggers", lambda d: F.lower(d).contains(t))
        df = df.where(has)
    return df.orderBy("rank")


def alert_detail(alerts: DataFrame, evidence: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id).join(evidence, "txid", "left")


def transaction_detail(results: dict[str, DataFrame], transactions: DataFrame, txid: str) -> DataFrame:
    """One row on a transaction from every result table; of repeated txids the last."""
    last = Window.partitionBy("txid").orderBy(F.desc("ts_us"), F.desc("event_id"))
    only = lambda df: df.where(F.col("txid") == txid)
    tx = only(transactions.withColumn("ts_us", F.unix_micros("timestamp"))).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    names = (("features", "features"), ("detections", "detections"), ("investigations", "investigation"), ("alerts", "alert"))
    for table, name in names:
        df = only(results[table])
        tx = tx.join(df.select("event_id", F.struct(*df.columns).alias(name)), "event_id", "left")
    ev = only(results["graph_evidence"])
    return tx.join(ev.select("txid", F.struct(*ev.columns).alias("graph")), "txid", "left")


def facets(alerts: DataFrame, transactions: DataFrame) -> DataFrame:
    """(facet, value): the distinct detectors and networks."""
    d = alerts.select(F.lit("detector").alias("facet"), F.explode("triggers").alias("value"))
    return d.unionByName(transactions.select(F.lit("asn").alias("facet"), F.col("asn").alias("value"))).where("value is not null").distinct()


def alert_kpis(alerts: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(level.isin("HIGH", "CRITICAL")).alias("high"), F.count_if(level != "LOW").alias("medium_up"),
        (F.avg("confidence_score") * 100).alias("mean_confidence"),
    )


def detector_hits(alerts: DataFrame) -> DataFrame:
    """Alerts per detector, zero where it never fired, with its family."""
    known = alerts.sparkSession.createDataFrame([(d, FAMILY[d]) for d in SCORED], "detector string, family string")
    hits = alerts.select(F.explode("triggers").alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return known.join(hits, "detector", "left").select("detector", "family", F.coalesce("n", F.lit(0)).alias("alerts"))


def risk_distribution(alerts: DataFrame) -> DataFrame:
    known = alerts.sparkSession.createDataFrame([(t,) for t in TIERS], "risk_level string")
    return known.join(alerts.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")), "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def transaction_summary(transactions: DataFrame, investigations: DataFrame) -> DataFrame:
    """One row per transaction: value, fee, sizes, IP, network, risk."""
    value = F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x)
    rows = transactions.select("event_id", "txid", value.alias("value"), "fee", F.size("input_addresses").alias("inputs"), F.size("output_addresses").alias("outputs"), "src_ip", "asn")
    return rows.join(investigations.select("event_id", "risk_score", "confidence_score", "risk_level", "triggers"), "event_id", "left")


def transaction_search(summary: DataFrame, level: str | None = None, detector: str | None = None, asn: str | None = None, text: str = "") -> DataFrame:
    df = summary
    for cond in (level and F.col("risk_level") == level, detector and F.array_contains("triggers", detector or ""), asn and F.col("asn") == asn):
        if cond is not None and not isinstance(cond, str):
            df = df.where(cond)
    if text:
        t = text.lower()
        df = df.where(F.lower("txid").contains(t) | F.lower("src_ip").contains(t) | F.lower("asn").contains(t) | F.exists("triggers", lambda d: F.lower(d).contains(t)))
    return df


def transaction_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("triggers") > 0).alias("flagged"), F.sum("value").alias("value"), F.avg("confidence_score").alias("mean_confidence")
    )


def entity_rollup(members: DataFrame, edges: DataFrame, alerts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per cluster: addresses, volume through them, alerts, first and last sight."""
    money = edges.where(F.col("edge_type").isin("INPUT_TO", "OUTPUT_TO")).select(F.col("target_id").alias("address"), F.col("source_id").alias("txid"), "amount", "ts_us")
    seen = members.join(money, "address")
    volume = seen.groupBy("cluster").agg(F.count_distinct("address").alias("addresses"), F.round(F.sum("amount"), 8).alias("volume"), F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"))
    flagged = seen.select("cluster", "txid").distinct().join(alerts.where(F.size("triggers") > 0).select("txid").distinct(), "txid", "left_semi")
    return volume.join(flagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("alerts")), "cluster", "left").na.fill(0, ["alerts"])


def graph_view(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, text: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visible nodes, edges between them, and counts per type."""
    n = nodes.where(F.col("node_type").isin(*kinds)) if kinds else nodes
    n = n.where(F.lower("node_id").contains(text.lower())) if text else n
    e = edges.join(n.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").join(n.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    return n, e, n.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def run_list(manifest: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    df = manifest.where(F.col("status") == status) if status else manifest
    return df.where(F.lower("run_id").contains(text.lower())) if text else df


def with_node_risk(nodes: DataFrame, investigations: DataFrame) -> DataFrame:
    """Nodes with the risk of the transaction they are, if any."""
    r = investigations.groupBy(F.col("txid").alias("node_id")).agg(F.max("risk_score").alias("risk_score"), F.max_by("risk_level", "risk_score").alias("risk_level"))
    return nodes.join(r, "node_id", "left")
