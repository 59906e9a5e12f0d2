"""Column functions shared by features, detectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_IP = ("unknown", "unknown_ip", "none", "null", "")
NO_LABEL = (*NO_IP, "n/a", "na")


def clamp_01(x: Column) -> Column:
    """Null and NaN are 0; the rest is clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def linear_scale(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, a line between; a step at ``low`` if there is no room."""
    if high <= low:
        return F.when(x >= high, 1.0).otherwise(0.0)
    return clamp_01((x - low) / (high - low))


def severity(score: Column, triggered: Column) -> Column:
    return (
        F.when(~triggered, "NONE").when(score >= 0.70, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")
    )


def ratio(a: Column, b: Column, otherwise: float = 0.0, over: float = 1e-12) -> Column:
    return F.when(b > over, a / b).otherwise(F.lit(otherwise))


def total(xs: Column) -> Column:
    """Sum of a list in its order; 0 for an empty or null list."""
    return F.aggregate(F.coalesce(xs, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def or_default(x: Column, default: float) -> Column:
    """Detectors read null and 0 alike as missing."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def clean_ip(x: Column) -> Column:
    t = F.trim(x)
    return F.when(~F.lower(t).isin(*NO_IP), t)


def clean_label(x: Column) -> Column:
    t = F.trim(x)
    return F.when(~F.lower(t).isin(*NO_LABEL), t)


def usable_ip(x: Column) -> Column:
    """The test of the rolling network features; null if the address can't be used."""
    return F.when(~x.isin("", "unknown_ip", "None", "none", "null", "0"), x)


def entity_key() -> Column:
    first = F.nullif(F.try_element_at("input_addresses", F.lit(1)), F.lit(""))
    return F.coalesce(first, F.concat(F.lit("ip_"), F.nullif(F.col("src_ip"), F.lit(""))), F.lit("unknown_entity"))


def combine(*scores: Column) -> Column:
    """s1 + (1 - s1) s2 / 4 of the two highest scores."""
    s = F.sort_array(F.array(*[F.coalesce(x, F.lit(0.0)) for x in scores], F.lit(0.0)), asc=False)
    return clamp_01(s[0] + (1 - s[0]) * 0.25 * s[1])


def round_up4(x: Column) -> Column:
    """Four digits; decimal ties go up, however they are stored."""
    return F.round(x + 1e-9, 4)
