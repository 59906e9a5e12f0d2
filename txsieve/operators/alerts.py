"""Evidence strength, priority and rank of investigations; tier filters and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.scalars import round_up4
from txsieve.functions.session import cut

TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def evidence_strength(evidence: Column) -> Column:
    """Half for the number of items (four are full), half for their severity, which items don't carry: 0.5."""
    n = F.size(evidence)
    return F.when(n > 0, round_up4(0.5 * F.least(F.lit(1.0), n / 4) + 0.25)).otherwise(0.0)


def with_priority(df: DataFrame) -> DataFrame:
    df = df.withColumn("evidence_strength", evidence_strength(F.col("evidence")))
    p = 0.60 * F.col("risk_score") + 0.20 * F.col("confidence_score") + 0.10 * F.col("signal_count") / 4 + 0.10 * F.col("evidence_strength")
    return df.withColumn("priority_score", round_up4(p))


ORDER = ("priority_score", "risk_score", "confidence_score")


def rank(df: DataFrame) -> DataFrame:
    """rank and alert_id of each row: priority, risk, confidence downwards, then txid and event_id.

    Rows are range-partitioned in that order and numbered within partitions; partition totals, one row
    each, give the offsets. No window sees all rows.
    """
    keys = [*[F.desc(c) for c in ORDER], F.asc("txid"), F.asc("event_id")]
    dealt = cut(with_priority(df).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*keys)
    ranked = dealt.withColumn("_i", F.row_number().over(within)).join(F.broadcast(before), "_part")
    ranked = ranked.withColumn("rank", (F.col("_before") + F.col("_i")).cast("long")).drop("_part", "_i", "_before")
    name = F.coalesce(F.nullif(F.substring("txid", 1, 16), F.lit("")), F.lit("UNKNOWN"))
    number = F.when(F.col("rank") < 10000, F.lpad(F.col("rank").cast("string"), 4, "0")).otherwise(F.col("rank").cast("string"))  # lpad cuts longer ones
    return ranked.withColumn("alert_id", F.concat(F.lit("ALT_"), name, F.lit("_"), number))


def filter_tier(df: DataFrame, tier: str) -> DataFrame:
    """ALL or LOW keep everything, MEDIUM and HIGH everything from there on (a + may follow), CRITICAL itself."""
    name = tier.strip().upper().removesuffix("+")
    if name == "ALL":
        return df
    if name not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    return df.where(F.col("risk_level").isin(*TIERS[TIERS.index(name) :]))


def top_k(df: DataFrame, k: int, tier: str = "ALL") -> DataFrame:
    """The first k alerts of a tier, with ranks from 1; alert ids stay."""
    few = filter_tier(df, tier).orderBy("rank").limit(k)  # k rows: the feature
    return few.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))
