"""The whole analysis as result tables."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from txsieve.functions.session import cut, prepare, scratch
from txsieve.operators import alerts, detectors, features, forest, fusion, graph, graph_query
from txsieve.schema import FEATURES

EVIDENCE = ["txid", "composite_graph_score", "graph_support_score", "graph_items", "degree", "weighted_degree", "component_size", "local_density", "temporal_links", "common_input_support", "nodes_2hop"]


@dataclass(frozen=True)
class Config:
    """Settings of a run; the defaults are the usual ones."""

    threshold: float = 0.50
    lineage_ttl_seconds: float | None = None
    window_seconds: float = 300
    max_links: int = 5
    clique: int = 20
    trees: int = 100
    seed: int = 42
    tier: str = "ALL"
    top_k: int | None = None
    with_forest: bool = True


class Meter:
    """Rows and times of a run's stages, counted while their tables are written: nothing is read again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, []

    def cut(self, name: str, df: DataFrame) -> DataFrame:
        seen, began = Observation(), time.monotonic()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
        self.stages.append((name, seen.get["n"], time.monotonic() - began))
        return out

    def table(self) -> DataFrame:
        """stage, n_rows, seconds, rows_per_second, in the order of STAGES."""
        rows = [(i, name, n, s, n / max(s, 1e-9)) for i, (name, n, s) in enumerate(sorted(self.stages, key=lambda s: STAGES.index(s[0])))]
        return self.spark.createDataFrame(rows, "place int, stage string, n_rows long, seconds double, rows_per_second double")


STAGES = ("features", "detections", "nodes", "edges", "graph_evidence", "investigations")
TABLES = (*STAGES, "alerts", "summary", "fingerprint", "metrics")


class Run:
    """An analysis by tables: each is made when it is first asked for, with those that it is made from, and kept.

    Nothing that a table does not read is made for it. Features and detections on one side, the graph and its evidence
    on the other, read nothing of each other, and are written at the same time where both are asked for.
    """

    def __init__(self, transactions: DataFrame, config: Config | None = None):
        self.config, self.spark = config or Config(), prepare(transactions.sparkSession)
        self.given, self.meter, self.made = transactions, Meter(self.spark), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            with scratch(self.spark) as kept:  # what a table was made from on the way is deleted once it is written
                table = getattr(self, f"_{name}")()
                table = table if isinstance(table, dict) else {name: table}
                kept += table.values()
            self.made |= table
        return self.made[name]

    def _transactions(self) -> DataFrame:
        return cut(self.given)  # every stage reads them

    def _features(self) -> DataFrame:
        return self.meter.cut("features", features.with_features(self["transactions"], self.config.lineage_ttl_seconds))

    def _detections(self) -> DataFrame:
        feats, cfg = self["features"], self.config
        if cfg.with_forest:
            ml = forest.anomaly_scores(feats, FEATURES, cfg.trees, seed=cfg.seed, threshold=cfg.threshold)
            feats = feats.join(ml.select("event_id", "isolation_forest_score"), "event_id", "left")
        return self.meter.cut("detections", detectors.detection_records(feats, cfg.threshold))

    def _fired(self) -> DataFrame:
        """event_id, txid, triggers of each investigation, before anything of the graph is known."""
        if "detections" in self.made or self.config.with_forest:
            records = self["detections"]
        else:  # rules are told by a row's features: the records, with all their columns, need not be written
            records = detectors.detection_records(self["features"], self.config.threshold)
        return records.select("event_id", "txid", fusion.fired().alias("triggers"))

    def _cleaned(self) -> DataFrame:
        return cut(graph.cleaned(self["transactions"]))

    def _graph(self) -> dict[str, DataFrame]:
        cfg = self.config
        nodes, edges = graph.build(self["transactions"], cfg.window_seconds, cfg.max_links, cfg.clique, self.meter.cut, self["cleaned"])
        return {"nodes": nodes, "edges": edges}

    _nodes = _edges = _graph

    def _graph_evidence(self) -> DataFrame:
        return self.meter.cut("graph_evidence", graph_query.graph_evidence(self["cleaned"], self["nodes"], self["edges"]))

    def _investigations(self) -> DataFrame:
        self["transactions"]  # both sides read them
        make = inheritable_thread_target(self.spark)(self.__getitem__)  # jobs keep the caller's tags and properties
        with ThreadPoolExecutor(2) as side:
            records, evidence = side.map(make, ("detections", "graph_evidence"))
        return self.meter.cut("investigations", fusion.investigations(records.join(evidence.select(*EVIDENCE), "txid", "left")))

    def _alerts(self) -> DataFrame:
        ranked, cfg = alerts.rank(self["investigations"]), self.config
        return cut(alerts.filter_tier(ranked, cfg.tier) if cfg.top_k is None else alerts.top_k(ranked, cfg.top_k, cfg.tier))

    def _summary(self) -> DataFrame:
        # without a limit, alerts are the investigations of the tier; to count them takes no ranks
        shown = self["alerts"] if self.config.top_k is not None else alerts.filter_tier(self["investigations"], self.config.tier)
        return summary(self["transactions"], shown, self["nodes"], self["edges"])

    def _fingerprint(self) -> DataFrame:
        return fingerprint(self["transactions"])

    def _metrics(self) -> DataFrame:
        for name in reversed(STAGES):
            self[name]
        return self.meter.table()


def analyze(transactions: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """features, detections, nodes, edges, graph_evidence, investigations, alerts, summary, fingerprint and metrics."""
    run = Run(transactions, config)
    return {name: run[name] for name in reversed(TABLES)}


def summary(transactions: DataFrame, ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of transactions, alerts by tier, nodes and edges."""
    tiers = ranked.agg(F.count(F.lit(1)).alias("alerts"), *[F.count_if(F.col("risk_level") == t).alias(t.lower()) for t in alerts.TIERS])
    counts = [transactions.agg(F.count(F.lit(1)).alias("transactions")), tiers, nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))]
    out = counts[0].withColumn("_one", F.lit(1))
    for c in counts[1:]:  # one row each
        out = out.join(c.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def fingerprint(transactions: DataFrame, prefix: str = "batch") -> DataFrame:
    """run_id: a digest of (txid, time) that doesn't depend on the order of rows."""
    h = F.xxhash64("txid", F.unix_micros("timestamp"))
    d = transactions.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return d.select(F.concat(F.lit(f"{prefix}_run_"), F.substring(F.sha2(F.concat_ws(":", "n", "x", "s"), 256), 1, 16)).alias("run_id"))
