"""Row-local features: amounts, local motifs and data quality. No shuffle; one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.functions.scalars import entity_key, ratio, total


def _d(x: Column) -> Column:
    return x.cast("double")


def with_order(df: DataFrame) -> DataFrame:
    """ts_us and entity: with txid and event_id, ts_us is the total order of all window features."""
    return df.withColumns({"ts_us": F.unix_micros("timestamp"), "entity": entity_key()})


def with_row_features(df: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    ins, outs = F.coalesce("input_addresses", empty), F.coalesce("output_addresses", empty)
    amounts = F.coalesce("output_amounts", F.array().cast("array<double>"))
    n_in, n_out, m = _d(F.size(ins)), _d(F.size(outs)), F.size(amounts)
    df = df.withColumns(
        {
            "input_count": n_in,
            "output_count": n_out,
            "raw_in": total(F.col("input_amounts")),
            "raw_out": total(F.col("output_amounts")),
            "_sats": F.transform(amounts, lambda x: F.round(x * 1e8).cast("long")),
            "_same": F.transform(amounts, lambda x: F.round(x, 8)),
            "fee": F.coalesce(F.col("fee"), F.lit(0.0)),
        }
    )
    mean = F.when(m > 0, F.col("raw_out") / m).otherwise(0.0)
    df = df.withColumn("_mean", mean)
    var = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / m
    std = F.when(m > 1, F.sqrt(var)).otherwise(0.0)
    tin, tout = F.round("raw_in", 8), F.round("raw_out", 8)
    i, o = F.col("input_count"), F.col("output_count")
    common = F.array_max(
        F.transform(F.array_distinct("_same"), lambda d: F.size(F.filter("_same", lambda x: x == d)))
    )
    share = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + (x / F.col("raw_out")) * (x / F.col("raw_out")))
    df = df.withColumns(
        {
            "total_input_amount": tin,
            "total_output_amount": tout,
            "fee_ratio": ratio(F.col("fee"), F.col("raw_in")),
            "input_output_count_ratio": F.when(o > 0, i / o).otherwise(0.0),
            "input_output_amount_ratio": ratio(F.col("raw_in"), F.col("raw_out")),
            "amount_mean": F.col("_mean"),
            "amount_std": std,
            "amount_cv": ratio(std, F.col("_mean")),
            "output_concentration": F.when(F.col("raw_out") > 1e-12, share).otherwise(0.0),
            "equal_output_ratio": F.when(m > 0, common / m).otherwise(0.0),
            "round_amount_ratio": F.when(
                m > 0, F.size(F.filter("_sats", lambda s: (s > 0) & (s % 500000 == 0))) / m
            ).otherwise(0.0),
            "fan_in_ratio": F.when(i + o > 0, i / (i + o)).otherwise(0.0),
            "fan_out_ratio": F.when(i + o > 0, o / (i + o)).otherwise(0.0),
        }
    )
    low = F.array_min(amounts)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    filled = lambda c: flag(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    listed = lambda c: flag(F.coalesce(F.size(c), F.lit(0)) > 0)
    text = ("event_id", "txid", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "fee", "script_type", "geo_country", "asn")
    lists = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
    net = ("src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "asn")
    add = lambda xs: sum(xs[1:], xs[0])
    positive = lambda c: F.forall(F.coalesce(c, F.array().cast("array<double>")), lambda x: x >= 0)
    return df.withColumns(
        {
            "fan_in_degree": i,
            "fan_out_degree": o,
            "bipartite_density": F.round(F.when(i * o > 0, (i + o) / (i * o)).otherwise(0.0), 4),
            "address_reuse_in_tx": _d(F.size(F.array_intersect(ins, outs))),
            "is_peeling_structure": flag(
                i.isin(1.0, 2.0) & (o == 2) & (F.col("raw_out") > 1e-8) & (low / F.col("raw_out") < 0.35)
            ),
            "is_consolidation_structure": flag((i >= 5) & (o <= 2)),
            "is_dispersion_structure": flag((i <= 2) & (o >= 5)),
            "is_equal_split_structure": flag((o >= 3) & (F.col("equal_output_ratio") >= 0.70)),
            "field_completeness": F.round(add([filled(c) for c in text] + [listed(c) for c in lists]) / 15, 4),
            "timestamp_valid": flag(F.col("timestamp").isNotNull()),
            "network_metadata_completeness": F.round(add([filled(c) for c in net]) / 6, 4),
            "amount_data_completeness": flag(
                (F.size("input_amounts") > 0) & (F.size("output_amounts") > 0) & (F.col("fee") >= 0)
                & positive(F.col("input_amounts")) & positive(F.col("output_amounts"))
            ),
        }
    ).drop("_sats", "_same", "_mean")
