"""Isolation forest as a distributed job (Liu, Ting and Zhou 2008).

Each tree takes the rows with the smallest seeded hashes, so the sample is the same wherever rows lie;
a threshold on the hash keeps the shuffle to a few times the sample. Trees are built one per group, the
small tree table is broadcast (trees x 2 x sample nodes at most), and rows are scored in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.session import cut, prepare
from txsieve.schema import FEATURES

TREES, SAMPLE, SEED, THRESHOLD = 100, 256, 42, 0.50
NODES = "tree int, node int, feature int, cut double, path double"


def _c(n: float) -> float:
    """Mean path of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def matrix(columns=FEATURES):
    """The ordered features as an array; null, NaN and infinite values are 0."""
    clean = lambda f: F.when(F.isnan(F.coalesce(F.col(f), F.lit(0.0))) | (F.abs(f) == float("inf")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
    return F.array(*[clean(f) for f in columns])


def fit(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The tree table. ``features`` has event_id and x, the feature array."""
    prepare(features.sparkSession)
    n = features.count()
    size = min(sample, n)
    if not n:
        return features.sparkSession.createDataFrame([], NODES)
    # about four samples' worth of rows pass for each tree; the smallest ``size`` of them are taken
    share = min(1.0, (4 * size + 64) / n)
    limit = min(2**63 - 1, int(-(2**63) + share * (2**64 - 1)))
    if trees <= TREES and share < 1:  # few rows pass for any tree: the others' arrays are not made
        features = features.where(F.least(F.lit(2**63 - 1), *[F.xxhash64("event_id", F.lit(t), F.lit(seed)) for t in range(trees)]) <= limit)
    tried = features.select(
        "event_id", "x",
        F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("event_id", t, F.lit(seed)).alias("h"))), lambda s: s.h <= limit)).alias("s"),
    )
    ranked = tried.select("s.tree", "s.h", "event_id", "x").withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", "event_id")))
    height = max(1, math.ceil(math.log2(max(2, size))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("event_id")
        tree = int(part["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(part["x"].to_list())
        out: list[tuple] = []

        def grow(node, rows, depth):
            spread = len(rows) > 1 and depth < height
            low, high = (x[rows].min(0), x[rows].max(0)) if spread else (x[:0], x[:0])
            open_ = np.flatnonzero(high > low) if spread else ()
            if not len(open_):
                out.append((tree, node, -1, 0.0, depth + _c(len(rows))))
                return
            f = int(rng.choice(open_))
            at = float(rng.uniform(low[f], high[f]))
            left = x[rows, f] < at
            out.append((tree, node, f, at, 0.0))
            grow(2 * node + 1, rows[left], depth + 1)
            grow(2 * node + 2, rows[~left], depth + 1)

        grow(0, np.arange(len(x)), 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "path"])

    return cut(ranked.where(F.col("r") <= size).groupBy("tree").applyInPandas(build, NODES))


def score(features: DataFrame, nodes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """event_id, raw = 0.5 - 2 ** (-mean path / c(sample)): lower is more anomalous."""
    prepare(features.sparkSession)
    rows = nodes.collect()  # trees x 2 x sample rows at most
    if not rows:
        return features.select("event_id", F.lit(0.0).alias("raw"))
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, r.path)
    norm = max(1e-9, _c(sample))

    def run(batches):
        for batch in batches:
            # rows of one length lie one after the other: no object is made for a value
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            total = np.zeros(len(x))

            def walk(tree, node, at, x=x, total=total):
                f, cut_, path = tree[node]
                if f < 0:
                    total[at] += path
                    return
                left = x[at, f] < cut_
                if left.any():
                    walk(tree, 2 * node + 1, at[left])
                if not left.all():
                    walk(tree, 2 * node + 2, at[~left])

            for tree in trees.values():
                if len(x):
                    walk(tree, 0, np.arange(len(x)))
            raw = 0.5 - 2.0 ** (-(total / len(trees)) / norm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw)], names=["event_id", "raw"])

    return features.select("event_id", "x").mapInArrow(run, "event_id string, raw double")


def anomaly_scores(features: DataFrame, columns=FEATURES, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """event_id, isolation_forest_score (0..1, calibrated on these rows) and its flag."""
    x = features.select("event_id", matrix(columns).alias("x"))  # a projection: not written a second time
    raw = cut(score(x, fit(x, trees, sample, seed), min(sample, max(1, features.count()))))
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    flat = low is None or high - low < 1e-12
    s = F.lit(0.5) if flat else (F.lit(high) - F.col("raw")) / (high - low)
    return raw.select("event_id", s.alias("isolation_forest_score"), (s >= threshold).alias("isolation_forest_triggered"))


def metadata(spark, rows: int, low: float, high: float, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One row on a fitted forest."""
    return spark.createDataFrame(
        [("isolation_forest", trees, sample, seed, len(FEATURES), rows, low, high)],
        "model string, trees int, sample int, seed int, features int, rows long, calibration_min double, calibration_max double",
    )
