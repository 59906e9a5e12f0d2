"""Detection quality against labels: counts, rates, ranking areas, distributions, scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.session import cut

from .detectors import SCORED

CATEGORIES = ("structural_score", "temporal_score", "network_score", "ml_anomaly_score")
SCENARIOS = ("benign", "fan_in", "fan_out", "peeling_like", "mixing_like", "rapid_hop", "network_cluster")
SCENARIO_DETECTORS = ("fan_in", "fan_out", "peeling_like", "mixing_like", "rapid_hop", "network_cluster", "isolation_forest")
FORBIDDEN = ("scenario", "is_benign", "entity_id", "scenario_instance_id", "parent_txid", "label")
THRESHOLDS = (0.25, 0.50, 0.75)


def align(records: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their labels, and one row of counts: duplicates, missing and extra labels, leaked columns."""
    joined = records.join(labels, "txid")
    leaked = [c for c in records.columns if c in FORBIDDEN]
    records, labels = cut(records.select("txid")), labels.select("txid")  # all that is counted
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("_k"))
    twice = lambda df, name: n(df.groupBy("txid").count().where("count > 1"), name)
    counts = [
        n(records, "records"), n(labels, "labels"), twice(records, "duplicate_records"), twice(labels, "duplicate_labels"),
        n(records.join(labels, "txid", "left_anti"), "missing_labels"), n(labels.join(records, "txid", "left_anti"), "extra_labels"), n(records.join(labels, "txid"), "aligned"),
    ]
    report = reduce(lambda a, b: a.join(b, "_k"), counts).drop("_k").withColumn("leaked_columns", F.lit(len(leaked)).cast("long"))
    return joined, report


#: What evaluation reads of a record and its label.
READ = ("event_id", "txid", *CATEGORIES, *[f"{d}_triggered" for d in SCORED], "overall_score", "is_benign", "scenario")


def overall_score(df: DataFrame) -> DataFrame:
    return df.withColumn("overall_score", F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in CATEGORIES]))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return df.groupBy(*(by or [])).agg(n(predicted & actual, "tp"), n(predicted & ~actual, "fp"), n(~predicted & ~actual, "tn"), n(~predicted & actual, "fn"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy, false_positive_rate; null where undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return counts.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn), "false_positive_rate": F.try_divide(fp, fp + tn)})


def areas(df: DataFrame, by: list[str], score: str, actual: Column) -> DataFrame:
    """roc_auc (ties count half; null with one class) and pr_auc (stepwise; null without positives), per group.

    Rows are counted per distinct score first; windows run over those counts only.
    """
    t = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(actual).cast("double").alias("p"), F.count_if(~actual).cast("double").alias("n"))
    up = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0.0)), "tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    g = t.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when((F.col("P") > 0) & (F.col("P") + F.col("N") >= 2), F.col("ap") / F.col("P")).alias("pr_auc"))


def tall_scores(df: DataFrame, columns=(*CATEGORIES, "overall_score")) -> DataFrame:
    """One row per record and score column: (category, score, ...)."""
    args = ", ".join(f"'{c}', `{c}`" for c in columns)
    return df.selectExpr("txid", "is_benign", "scenario", f"stack({len(columns)}, {args}) as (category, score)")


def sweep(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Binary metrics of each score column at each threshold."""
    t = tall_scores(df).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return binary_metrics(confusion(t, F.coalesce(F.col("score"), F.lit(0.0)) >= F.col("threshold"), ~F.col("is_benign"), ["category", "threshold"]))


def category_areas(df: DataFrame) -> DataFrame:
    return areas(tall_scores(df), ["category"], "score", ~F.col("is_benign"))


def tall_flags(df: DataFrame, detectors=SCORED) -> DataFrame:
    args = ", ".join(f"'{d}', `{d}_triggered`" for d in detectors)
    return df.selectExpr("txid", "is_benign", "scenario", f"stack({len(detectors)}, {args}) as (detector, triggered)")


def detector_metrics(df: DataFrame) -> DataFrame:
    return binary_metrics(confusion(tall_flags(df), F.col("triggered"), ~F.col("is_benign"), ["detector"]))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, mean and exact percentiles; nulls and NaN are left out."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    g = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), q.alias("q")
    )
    return g.select(*by, "n", "min", "max", "mean", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("p50", "p90", "p95", "p99"))])


def class_distributions(df: DataFrame) -> DataFrame:
    """Per score column: both classes' distribution side by side, and the gaps of mean and median."""
    d = distribution(tall_scores(df), ["category", "is_benign"], "score")
    stats = ("n", "mean", "p50", "p95", "max")
    side = lambda benign, name: d.where(F.col("is_benign") == benign).select("category", *[F.col(s).alias(f"{name}_{s}") for s in stats])
    both = side(True, "benign").join(side(False, "anomalous"), "category", "full")
    return both.withColumns({"mean_gap": F.col("anomalous_mean") - F.col("benign_mean"), "median_gap": F.col("anomalous_p50") - F.col("benign_p50")})


def scenario_recall(df: DataFrame, threshold: float = 0.50) -> DataFrame:
    s = F.col("overall_score")
    g = df.groupBy("scenario").agg(F.count(F.lit(1)).alias("total"), F.count_if(s >= threshold).alias("triggered"), F.avg(s).alias("mean_score"), F.percentile(s, F.lit(0.5)).alias("median_score"))
    return g.withColumn("recall", F.col("triggered") / F.col("total"))


def scenario_matrix(df: DataFrame) -> DataFrame:
    """Rate at which each detector fires in each scenario; 0 where a scenario is empty."""
    t = tall_flags(df, SCENARIO_DETECTORS)
    return t.groupBy("detector").pivot("scenario", list(SCENARIOS)).agg(F.avg(F.col("triggered").cast("double"))).na.fill(0.0)


def top_benign(df: DataFrame, k: int = 5) -> DataFrame:
    """The k benign rows that score highest in each category, with the detectors that fired."""
    fired = F.array_sort(F.filter(F.array(*[F.when(F.col(f"{d}_triggered"), F.lit(d)) for d in SCORED]), lambda x: x.isNotNull()))
    few = df.where("is_benign").withColumn("fired", fired)
    args = ", ".join(f"'{c}', `{c}`" for c in CATEGORIES)
    tall = few.selectExpr("txid", "fired", f"stack({len(CATEGORIES)}, {args}) as (category, score)").where("score > 0")
    r = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "txid"))
    return tall.withColumn("rank", r).where(F.col("rank") <= k)


def feature_audit(registry: DataFrame, used: list[str]) -> DataFrame:
    """Per group: registered features, and how many the rules read."""
    return registry.groupBy("feature_group").agg(F.count(F.lit(1)).alias("registered"), F.count_if(F.col("feature").isin(used)).alias("used_by_rules"))


def scenario_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


def report(records: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """All evaluation tables of one run."""
    joined, alignment = align(overall_score(records), labels)
    return {
        "alignment": alignment, "thresholds": sweep(joined), "areas": category_areas(joined), "detectors": detector_metrics(joined),
        "distributions": class_distributions(joined), "scenario_recall": scenario_recall(joined), "scenario_matrix": scenario_matrix(joined),
        "top_benign": top_benign(joined), "ground_truth": scenario_counts(labels),
    }
