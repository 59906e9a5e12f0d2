"""The rule detectors as columns, all in one projection, with their evidence.

DETECTORS is a registry: name -> function that returns the score before clipping. Scores are rounded to four
digits; flags compare the unrounded score with the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.functions.scalars import clamp_01, linear_scale, or_default, severity

ls = linear_scale
c = F.col


def one(name: str) -> Column:
    return or_default(F.col(name), 1.0)


def gated(gate: Column, score: Column) -> Column:
    return F.when(gate, score).otherwise(0.0)


def _equal_output() -> Column:
    even = F.when(c("amount_cv") < 0.5, 0.10 * (1 - F.least(F.lit(1.0), c("amount_cv")))).otherwise(0.0)
    score = 0.55 * ls(c("equal_output_ratio"), 0.5, 0.9) + 0.25 * c("is_equal_split_structure") + 0.10 * ls(c("output_count"), 3, 10)
    return gated(c("output_count") >= 3, score + even)


def _network_cluster() -> Column:
    s = [ls(c("ip_reuse_count"), 2, 8), ls(one("endpoint_recurrence"), 2, 6), ls(one("unique_addresses_per_ip"), 2, 6), ls(one("src_port_frequency"), 3, 15)]
    return 0.30 * ls(c("asn_concentration"), 0.7, 1.0) + 0.45 * F.greatest(*s) + 0.25 * (s[0] + s[1] + s[2] + s[3]) / 4


DETECTORS: dict[str, Callable[[], Column]] = {
    "fan_in": lambda: 0.55 * ls(c("input_count"), 4, 24) + 0.30 * ls(c("fan_in_ratio"), 0.6, 0.9) + 0.15 * c("is_consolidation_structure"),
    "fan_out": lambda: 0.50 * ls(c("output_count"), 4, 24) + 0.30 * ls(c("fan_out_ratio"), 0.6, 0.9)
    + 0.10 * c("is_dispersion_structure") + 0.10 * c("round_amount_ratio"),
    "equal_output": _equal_output,
    "peeling_like": lambda: gated(
        c("input_count").isin(1.0, 2.0) & (c("output_count") == 2), 0.60 * ls(c("output_concentration"), 0.6, 0.95) + 0.40 * c("is_peeling_structure")
    ),
    "mixing_like": lambda: gated(
        (c("input_count") >= 3) & (c("output_count") >= 3),
        0.30 * ls(c("input_count"), 3, 8) + 0.30 * ls(c("output_count"), 3, 10) + 0.30 * ls(c("equal_output_ratio"), 0.45, 0.85)
        + 0.10 * c("is_equal_split_structure"),
    ),
    "temporal_burst": lambda: gated(
        c("tx_count_1h") > 1, 0.50 * ls(one("burst_score"), 1.5, 6) + 0.35 * ls(one("velocity_ratio"), 1.5, 6) + 0.15 * ls(c("tx_count_5m"), 3, 10)
    ),
    "rapid_hop": lambda: gated(
        (c("history_count") >= 1) & (c("median_interarrival") > 0) & (c("median_interarrival") <= 120),
        0.70 * ls(120 - c("median_interarrival"), 0, 110) + 0.30 * ls(c("tx_count_5m"), 2, 6),
    ),
    "baseline_deviation": lambda: gated(
        c("baseline_stability") >= 0.20, (0.65 * ls(c("baseline_deviation"), 2, 8) + 0.35 * ls(one("activity_change"), 2, 6)) * c("baseline_stability")
    ),
    "ip_reuse": lambda: 0.60 * ls(c("ip_reuse_count"), 3, 20) + 0.40 * ls(one("unique_addresses_per_ip"), 2, 8),
    "network_cluster": _network_cluster,
    "endpoint_recurrence": lambda: 0.75 * ls(one("endpoint_recurrence"), 3, 15) + 0.25 * ls(c("ip_reuse_count"), 5, 20),
}
CATEGORY = {
    "structural": ("fan_in", "fan_out", "equal_output", "peeling_like", "mixing_like"),
    "temporal": ("temporal_burst", "rapid_hop", "baseline_deviation"),
    "network": ("ip_reuse", "network_cluster", "endpoint_recurrence"),
    "ml": ("isolation_forest",),
}
FAMILY = {d: k for k, ds in CATEGORY.items() for d in ds}
SCORED = [*DETECTORS, "isolation_forest"]

#: Evidence: detector -> (feature, least value that is worth a line, text). The cut-offs.
EVIDENCE = {
    "fan_in": (("input_count", 5, "%.0f inputs are gathered"), ("fan_in_ratio", 0.70, "inputs are %.2f of all ends"), ("is_consolidation_structure", 1, "five or more inputs go to one or two outputs")),
    "fan_out": (("output_count", 5, "%.0f outputs are paid"), ("fan_out_ratio", 0.70, "outputs are %.2f of all ends"), ("is_dispersion_structure", 1, "one or two inputs go to five or more outputs")),
    "equal_output": (("equal_output_ratio", 0.50, "%.2f of the outputs have the same amount"), ("is_equal_split_structure", 1, "three or more outputs are split evenly")),
    "peeling_like": (("output_concentration", 0.60, "one output holds nearly all (%.2f)"), ("is_peeling_structure", 1, "a small output is peeled off")),
    "mixing_like": (("input_count", 3, "%.0f inputs meet"), ("output_count", 3, "%.0f outputs leave"), ("equal_output_ratio", 0.45, "%.2f of the outputs have the same amount")),
    "temporal_burst": (("burst_score", 1.5, "%.2f times the hour's rate within five minutes"), ("velocity_ratio", 1.5, "%.2f times the hour's volume within five minutes"), ("tx_count_5m", 3, "%.0f transactions within five minutes")),
    "rapid_hop": (("median_interarrival", 0, "half of the gaps are under %.1f s"), ("tx_count_5m", 2, "%.0f transactions within five minutes")),
    "baseline_deviation": (("baseline_deviation", 2, "the amount is %.2f deviations off the median"), ("activity_change", 2, "%.2f times the usual activity")),
    "ip_reuse": (("ip_reuse_count", 3, "%.0f earlier transactions from this address"), ("unique_addresses_per_ip", 2, "%.0f entities behind this address")),
    "network_cluster": (("asn_concentration", 0.70, "one network carries %.2f of the traffic"), ("ip_reuse_count", 2, "%.0f earlier transactions from this address"), ("endpoint_recurrence", 2, "the same two ends met %.0f times"), ("unique_addresses_per_ip", 2, "%.0f entities behind this address"), ("src_port_frequency", 3, "the source port came %.0f times")),
    "endpoint_recurrence": (("endpoint_recurrence", 3, "the same two ends met %.0f times"), ("ip_reuse_count", 5, "%.0f earlier transactions from this address")),
}


def evidence_of(name: str, score: Column) -> Column:
    """Array of (feature, value, reason) of the features over their cut-offs; empty for a score of 0."""
    items = []
    for feature, least, text in EVIDENCE[name]:
        v = F.col(feature).cast("double")
        reason = F.format_string(text, v) if "%" in text else F.lit(text)
        items.append(F.when((v >= least) & (score > 0), F.struct(F.lit(feature).alias("feature"), F.round(v, 6).alias("value"), reason.alias("reason"))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def with_scores(features: DataFrame, threshold: float = 0.50) -> DataFrame:
    """<detector> (4 digits) and <detector>_triggered of each rule; nulls in features count as 0."""
    raw = {f"_raw_{k}": clamp_01(f()) for k, f in DETECTORS.items()}
    df = features.withColumns(raw)
    out = {}
    for k in DETECTORS:
        out[f"{k}_score"] = F.round(F.col(f"_raw_{k}") + 1e-9, 4)  # decimal ties go up, however they are stored
        out[f"{k}_triggered"] = F.col(f"_raw_{k}") >= threshold
    return df.withColumns(out).drop(*raw)


def category_score(category: str) -> Column:
    scores = [F.col(f"{d}_score") for d in CATEGORY[category] if d in DETECTORS]
    return F.greatest(*scores)


def detection_records(features: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Category scores and flags; ``isolation_forest_score`` is used where the features have it, else 0."""
    has_ml = "isolation_forest_score" in features.columns
    ml = F.coalesce(F.col("isolation_forest_score"), F.lit(0.0)) if has_ml else F.lit(0.0)
    df = with_scores(features, threshold).withColumn("isolation_forest_score", ml).withColumn("isolation_forest_triggered", ml >= threshold)
    return df.withColumns({f"{k}_score": category_score(k) for k in ("structural", "temporal", "network")} | {"ml_anomaly_score": F.col("isolation_forest_score")})


def detector_results(features: DataFrame, threshold: float = 0.50, texts: bool = True) -> DataFrame:
    """One row per transaction and rule: score, flag, severity, evidence and the features it read.

    Without ``texts`` neither evidence nor features: Spark would make both for each row, whether they are read or not.
    """
    scored = with_scores(features, threshold)
    told = lambda k: [evidence_of(k, F.col(f"{k}_score")).alias("evidence"), F.create_map(*[x for f, _, _ in EVIDENCE[k] for x in (F.lit(f), F.col(f).cast("double"))]).alias("feature_values")]
    results = F.array(
        *[
            F.struct(
                F.lit(k).alias("detector"), F.col(f"{k}_score").alias("score"), F.col(f"{k}_triggered").alias("triggered"),
                severity(F.col(f"{k}_score"), F.col(f"{k}_triggered")).alias("severity"), *(told(k) if texts else []),
            )
            for k in DETECTORS
        ]
    )
    return scored.select("event_id", "txid", "ts_us", F.explode(results).alias("r")).select("event_id", "txid", "ts_us", "r.*")
