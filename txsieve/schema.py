"""Canonical transaction schema and the feature registry."""

from __future__ import annotations

from pyspark.sql import types as T

FEATURE_SCHEMA_VERSION = "1.0"
#: Of the weights and formulas behind risk and confidence; investigations and alerts carry it.
SCORING_VERSION = "1.0"

CANONICAL = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("txid", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("input_addresses", T.ArrayType(T.StringType())),
        T.StructField("output_addresses", T.ArrayType(T.StringType())),
        T.StructField("input_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("output_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("fee", T.DoubleType()),
        T.StructField("script_type", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("asn", T.StringType()),
        T.StructField("source_batch_id", T.StringType()),
        T.StructField("ingest_time", T.TimestampType()),
    ]
)
LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
RAW = [f.name for f in CANONICAL if f.name not in ("source_batch_id", "ingest_time")]

#: Feature names by group. They are the columns of the feature table.
GROUPS = {
    "TRANSACTION": (
        "input_count", "output_count", "total_input_amount", "total_output_amount", "fee", "fee_ratio",
        "input_output_count_ratio", "input_output_amount_ratio", "amount_mean", "amount_std", "amount_cv",
        "output_concentration", "equal_output_ratio", "round_amount_ratio", "fan_in_ratio", "fan_out_ratio",
    ),
    "TEMPORAL": (
        "tx_count_5m", "tx_count_1h", "tx_count_24h", "volume_5m", "volume_1h", "volume_24h", "mean_interarrival",
        "median_interarrival", "burst_score", "velocity_ratio", "history_count", "baseline_stability",
    ),
    "NETWORK": (
        "unique_ips", "unique_addresses_per_ip", "ip_reuse_count", "unique_asns", "asn_concentration", "unique_countries",
        "country_count", "src_port_frequency", "dst_port_frequency", "endpoint_recurrence", "ip_reuse_count_24h",
        "unique_addresses_per_ip_24h", "endpoint_recurrence_24h",
    ),
    "ENTITY": (
        "entity_tx_count", "entity_volume", "entity_age_seconds", "unique_counterparties", "unique_ips",
        "historical_median_amount", "historical_MAD_amount", "baseline_deviation", "activity_change",
    ),
    "GRAPH": (
        "fan_in_degree", "fan_out_degree", "bipartite_density", "address_reuse_in_tx", "is_peeling_structure",
        "is_consolidation_structure", "is_dispersion_structure", "is_equal_split_structure",
    ),
    "DATA_QUALITY": (
        "field_completeness", "timestamp_valid", "network_metadata_completeness", "amount_data_completeness",
    ),
}
FEATURES = list(dict.fromkeys(name for names in GROUPS.values() for name in names))
_INF = float("inf")
#: Feature, unit, low, high, and whether low itself is out.
_RANGES = (
    ("input_count", "count", 1.0, _INF, False),
    ("output_count", "count", 1.0, _INF, False),
    ("total_input_amount", "BTC", 0.0, _INF, False),
    ("total_output_amount", "BTC", 0.0, _INF, False),
    ("fee", "BTC", 0.0, _INF, False),
    ("fee_ratio", "ratio", 0.0, 1.0, False),
    ("input_output_count_ratio", "ratio", 0.0, _INF, False),
    ("input_output_amount_ratio", "ratio", 1.0, _INF, False),
    ("amount_mean", "BTC", 0.0, _INF, False),
    ("amount_std", "BTC", 0.0, _INF, False),
    ("amount_cv", "ratio", 0.0, _INF, False),
    ("output_concentration", "index", 0.0, 1.0, True),
    ("equal_output_ratio", "ratio", 0.0, 1.0, True),
    ("round_amount_ratio", "ratio", 0.0, 1.0, False),
    ("fan_in_ratio", "ratio", 0.0, 1.0, False),
    ("fan_out_ratio", "ratio", 0.0, 1.0, False),
    ("tx_count_5m", "count", 1.0, _INF, False),
    ("tx_count_1h", "count", 1.0, _INF, False),
    ("tx_count_24h", "count", 1.0, _INF, False),
    ("volume_5m", "BTC", 0.0, _INF, False),
    ("volume_1h", "BTC", 0.0, _INF, False),
    ("volume_24h", "BTC", 0.0, _INF, False),
    ("mean_interarrival", "seconds", 0.0, _INF, False),
    ("median_interarrival", "seconds", 0.0, _INF, False),
    ("burst_score", "ratio", 0.0, _INF, False),
    ("velocity_ratio", "ratio", 0.0, _INF, False),
    ("history_count", "count", 0.0, _INF, False),
    ("baseline_stability", "score", 0.0, 1.0, False),
    ("unique_ips", "count", 1.0, _INF, False),
    ("unique_addresses_per_ip", "count", 1.0, _INF, False),
    ("ip_reuse_count", "count", 0.0, _INF, False),
    ("unique_asns", "count", 1.0, _INF, False),
    ("asn_concentration", "index", 0.0, 1.0, True),
    ("unique_countries", "count", 1.0, _INF, False),
    ("country_count", "count", 1.0, _INF, False),
    ("src_port_frequency", "count", 1.0, _INF, False),
    ("dst_port_frequency", "count", 1.0, _INF, False),
    ("endpoint_recurrence", "count", 1.0, _INF, False),
    ("ip_reuse_count_24h", "count", 0.0, _INF, False),
    ("unique_addresses_per_ip_24h", "count", 1.0, _INF, False),
    ("endpoint_recurrence_24h", "count", 1.0, _INF, False),
    ("entity_tx_count", "count", 1.0, _INF, False),
    ("entity_volume", "BTC", 0.0, _INF, False),
    ("entity_age_seconds", "seconds", 0.0, _INF, False),
    ("unique_counterparties", "count", 1.0, _INF, False),
    ("historical_median_amount", "BTC", 0.0, _INF, False),
    ("historical_MAD_amount", "BTC", 0.0, _INF, False),
    ("baseline_deviation", "score", 0.0, _INF, False),
    ("activity_change", "ratio", 0.0, _INF, False),
    ("fan_in_degree", "count", 1.0, _INF, False),
    ("fan_out_degree", "count", 1.0, _INF, False),
    ("bipartite_density", "ratio", 0.0, 2.0, False),
    ("address_reuse_in_tx", "count", 0.0, _INF, False),
    ("is_peeling_structure", "binary", 0.0, 1.0, False),
    ("is_consolidation_structure", "binary", 0.0, 1.0, False),
    ("is_dispersion_structure", "binary", 0.0, 1.0, False),
    ("is_equal_split_structure", "binary", 0.0, 1.0, False),
    ("field_completeness", "ratio", 0.0, 1.0, False),
    ("timestamp_valid", "binary", 0.0, 1.0, False),
    ("network_metadata_completeness", "ratio", 0.0, 1.0, False),
    ("amount_data_completeness", "binary", 0.0, 1.0, False),
)
#: feature -> (unit, low, high, low is out)
RANGES = {name: row for name, *row in _RANGES}

#: What each feature is.
DEFINITIONS = {
    "input_count": "inputs", "output_count": "outputs", "total_input_amount": "sum of what is spent, fee included",
    "total_output_amount": "sum of the outputs", "fee": "fee paid", "fee_ratio": "fee by the amount spent",
    "input_output_count_ratio": "inputs by outputs", "input_output_amount_ratio": "amount spent by amount received",
    "amount_mean": "mean output", "amount_std": "standard deviation of the outputs", "amount_cv": "standard deviation by mean",
    "output_concentration": "sum of squared shares of the outputs", "equal_output_ratio": "largest share of outputs of one amount",
    "round_amount_ratio": "share of round outputs", "fan_in_ratio": "inputs by all addresses", "fan_out_ratio": "outputs by all addresses",
    "tx_count_5m": "the entity's transactions in five minutes", "tx_count_1h": "the same in an hour", "tx_count_24h": "the same in a day",
    "volume_5m": "the entity's outputs in five minutes", "volume_1h": "the same in an hour", "volume_24h": "the same in a day",
    "mean_interarrival": "mean gap of the last hundred transactions", "median_interarrival": "median of these gaps",
    "burst_score": "rate of five minutes by that of the hour", "velocity_ratio": "volume of five minutes by that of the hour",
    "history_count": "earlier transactions", "baseline_stability": "how far the history suffices, up to 15",
    "unique_ips": "the entity's addresses of origin so far", "unique_addresses_per_ip": "entities of the origin in an hour",
    "ip_reuse_count": "other transactions of the origin in an hour", "unique_asns": "the entity's networks so far",
    "asn_concentration": "sum of squared shares of these networks", "unique_countries": "the entity's countries so far",
    "country_count": "transactions of the country so far", "src_port_frequency": "transactions of the source port so far",
    "dst_port_frequency": "transactions of the target port so far", "endpoint_recurrence": "transactions of the pair of ends in an hour",
    "ip_reuse_count_24h": "other transactions of the origin in a day", "unique_addresses_per_ip_24h": "entities of the origin in a day",
    "endpoint_recurrence_24h": "transactions of the pair of ends in a day", "entity_tx_count": "the entity's transactions so far",
    "entity_volume": "the entity's outputs so far", "entity_age_seconds": "time since the entity's first transaction",
    "unique_counterparties": "receivers of the entity so far", "historical_median_amount": "median of the last 200 amounts before",
    "historical_MAD_amount": "median distance from it", "baseline_deviation": "distance from the median in scaled median distances",
    "activity_change": "the hour's rate by the rate before", "fan_in_degree": "inputs, as a degree", "fan_out_degree": "outputs, as a degree",
    "bipartite_density": "edges by possible ones between inputs and outputs", "address_reuse_in_tx": "addresses on both sides",
    "is_peeling_structure": "one small and one large output", "is_consolidation_structure": "many inputs to one or two outputs",
    "is_dispersion_structure": "one or two inputs to many outputs", "is_equal_split_structure": "most of three outputs or more are equal",
    "field_completeness": "share of fields that are there", "timestamp_valid": "the time can be read",
    "network_metadata_completeness": "share of network fields that are there", "amount_data_completeness": "the outputs have amounts",
}


def registry(spark):
    """(feature, feature_group, definition, unit, low, high, low_out), one row per slot; no high is null."""
    rows = [
        (n, g, DEFINITIONS[n], u, low, None if high == _INF else high, out) for g, names in GROUPS.items() for n in names for u, low, high, out in [RANGES[n]]
    ]
    return spark.createDataFrame(rows, "feature string, feature_group string, definition string, unit string, low double, high double, low_out boolean")
