"""The feature table: one row per transaction, every group of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.functions.session import cut
from txsieve.schema import FEATURE_SCHEMA_VERSION, FEATURES, GROUPS, RANGES, registry

from . import rolling, rows


def with_features(df: DataFrame, lineage_ttl_seconds: float | None = None) -> DataFrame:
    """The canonical columns, ts_us, entity, lineage and all features.

    The canonical rows are written once; what follows keys is computed from narrow rows and joins them on event_id,
    and row-local features are computed there, so they are neither written nor shuffled before.
    """
    given = cut(rows.with_order(df))
    base = rows.with_row_features(given)
    slim, parts = rolling.with_history(base, lineage_ttl_seconds)
    full = rolling.with_entity(rolling.with_network(rolling.with_temporal(slim, parts), parts, slim))
    groups = dict.fromkeys(n for g in ("TEMPORAL", "NETWORK", "ENTITY") for n in GROUPS[g])
    late = ["chain_parent", "chain_interval", "chain_hops", *groups]
    both = given.join(full.select("event_id", *late), "event_id")
    return rows.with_row_features(both).select("event_id", *[c for c in base.columns if c != "event_id"], *late)


def feature_table(df: DataFrame, **settings) -> DataFrame:
    full = with_features(df, **settings)
    return full.select(
        "event_id", "txid", "ts_us", F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"), *[F.col(f).cast("double").alias(f) for f in FEATURES]
    )


def range_check(features: DataFrame) -> DataFrame:
    """Of each registered feature: rows, nulls and values out of its range (by more than rounding).

    One pass counts all features of a row side by side; rows are not made tall.
    """
    counts = [F.count(F.lit(1)).alias("_rows")]
    for f in FEATURES:
        _, low, high, low_out = RANGES[f]
        x = F.col(f)
        out = (x < low - 1e-9) | ((x <= low) if low_out else F.lit(False))
        if high != float("inf"):
            out |= x > high + 1e-9
        counts += [F.count_if(x.isNull()).alias(f"_null_{f}"), F.count_if(out).alias(f"_out_{f}")]
    args = ", ".join(f"'{f}', `_rows`, `_null_{f}`, `_out_{f}`" for f in FEATURES)
    tall = features.agg(*counts).where("_rows > 0").selectExpr(f"stack({len(FEATURES)}, {args}) as (feature, n_rows, n_null, n_out)")
    known = registry(features.sparkSession).groupBy("feature").agg(F.min("feature_group").alias("feature_group"))
    return tall.join(F.broadcast(known), "feature").select("feature", "feature_group", "n_rows", "n_null", "n_out")
