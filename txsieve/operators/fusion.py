"""Risk and confidence per transaction, from detectors and graph evidence. One projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.functions.scalars import clamp_01, combine, ratio, round_up4
from txsieve.schema import SCORING_VERSION

from .detectors import CATEGORY, FAMILY, SCORED, evidence_of

WEIGHTS = {"ml": 0.45, "graph": 0.25, "temporal": 0.20, "network": 0.10}
#: Category of each family of detectors in the fusion.
COMPONENT = {"ml": "ml", "structural": "graph", "temporal": "temporal", "network": "network"}


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.80, "CRITICAL").when(risk >= 0.60, "HIGH").when(risk >= 0.40, "MEDIUM").otherwise("LOW")


def _scores(category: str, fallback: str) -> Column:
    s = combine(*[F.col(f"{d}_score") for d in CATEGORY[category]])
    return F.when(s > 0, s).otherwise(clamp_01(F.col(fallback)))


def fired(use_flags: bool = False) -> Column:
    """The detectors that fired, sorted: by the score that a record shows, or by its flags."""
    hit = lambda d: F.col(f"{d}_triggered") if use_flags else F.col(f"{d}_score") >= 0.50
    return F.array_sort(F.filter(F.array(*[F.when(hit(d), F.lit(d)) for d in SCORED]), lambda x: x.isNotNull()))


def investigations(records: DataFrame, use_flags: bool = False) -> DataFrame:
    """``records``: detection records with the features and graph evidence joined on (nulls where missing)."""
    composite = F.coalesce(F.col("composite_graph_score"), F.lit(0.0))
    df = records.withColumns(
        {
            "component_ml": _scores("ml", "ml_anomaly_score"), "_g": _scores("structural", "structural_score"),
            "component_temporal": _scores("temporal", "temporal_score"), "component_network": _scores("network", "network_score"),
        }
    )
    df = df.withColumn("component_graph", clamp_01(F.when(F.col("_g") > 0, F.col("_g") + (1 - F.col("_g")) * 0.30 * composite).otherwise(0.60 * composite)))
    part = {k: F.col(f"component_{k}") for k in WEIGHTS}
    risk = clamp_01(0.45 * part["ml"] + 0.25 * part["graph"] + 0.20 * part["temporal"] + 0.10 * part["network"])
    family = F.filter(F.array(*[F.when(F.array_contains("triggers", d), F.lit(COMPONENT[FAMILY[d]])) for d in SCORED]), lambda x: x.isNotNull())
    strong = F.filter(F.array(*[F.when(c >= 0.50, F.lit(k)) for k, c in part.items()]), lambda x: x.isNotNull())
    tag = lambda d: F.transform(evidence_of(d, F.col(f"{d}_score")), lambda e: F.struct(F.lit(d).alias("detector"), F.lit(COMPONENT[FAMILY[d]]).alias("category"), e.feature.alias("metric"), e.value.alias("value"), e.reason.alias("reason")))
    rules = [F.when(F.array_contains("triggers", d), tag(d)).otherwise(F.filter(tag(d), lambda x: F.lit(False))) for d in SCORED if d != "isolation_forest"]
    graph = F.transform("graph_items", lambda e: F.struct(F.lit("graph").alias("detector"), F.lit("graph").alias("category"), e.metric.alias("metric"), e.value.alias("value"), e.reason.alias("reason")))
    df = df.withColumns({"risk_score": round_up4(risk), "triggers": fired(use_flags)})
    df = df.withColumns({"categories": F.array_sort(F.array_union(family, strong)), "_items": F.flatten(F.array(*rules, F.coalesce(graph, F.filter(rules[0], lambda x: F.lit(False)))))})
    # the first item of each metric stays
    first = F.filter("_items", lambda x, i: F.array_position(F.transform("_items", lambda y: y.metric), x.metric) == i + 1)
    n, t = F.size("categories"), F.size("triggers")
    df = df.withColumns({"evidence": first, "signal_count": n, "cross_category": n >= 2})
    data = F.coalesce(0.4 * F.col("field_completeness") + 0.2 * F.col("timestamp_valid") + 0.2 * F.col("network_metadata_completeness") + 0.2 * F.col("amount_data_completeness"), F.lit(0.85))
    agree = 0.70 * n / 4 + 0.30 * F.least(F.lit(1.0), t / 3)
    stable = F.coalesce(F.col("baseline_stability"), F.least(F.lit(1.0), F.col("history_count") / 5), F.lit(0.5))
    motifs = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("is_peeling_structure", "is_consolidation_structure", "is_dispersion_structure", "is_equal_split_structure", "bipartite_density")])
    support = F.coalesce(F.col("graph_support_score"), motifs, part["graph"])
    explained = F.when(t > 0, ratio(F.size(F.filter("evidence", lambda x: F.coalesce(x.reason, F.lit("")) != "")).cast("double"), F.size("evidence").cast("double"))).otherwise(1.0)
    confidence = clamp_01(0.25 * clamp_01(data) + 0.30 * clamp_01(agree) + 0.20 * clamp_01(stable) + 0.15 * clamp_01(support) + 0.10 * clamp_01(explained))
    return df.withColumns({"confidence_score": round_up4(confidence), "risk_level": risk_level(F.col("risk_score"))}).select(
        "event_id", "txid", "ts_us", "risk_score", "confidence_score", "risk_level", *[f"component_{k}" for k in WEIGHTS], "triggers", "categories", "signal_count", "cross_category", "evidence", F.lit(SCORING_VERSION).alias("scoring_version")
    )
