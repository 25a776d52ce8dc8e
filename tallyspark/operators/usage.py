"""Volume buckets, window sums and the cache-hit rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.counters import CounterMath

BUCKET = ("model", "tier_kind", "tier_text", "band")
MEASURES = {"uncached": "delta_uncached", "cached": "delta_cached", "output": "delta_output"}


def usage_volumes(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """In-plan usage per (model, tier, band); NULL model and tier are groups.

    Overflow and zero-delta events stay out. Partial aggregation shrinks each
    input split to a few buckets before anything is shuffled.
    """
    math = CounterMath.of(events, "delta_total")
    counted = events.where(~F.col("overflow") & (F.col("delta_total") != 0))
    return counted.groupBy(*keys, *BUCKET).agg(
        *[math.sum(F.col(column)).alias(name) for name, column in MEASURES.items()],
        F.bool_or("details_missing").alias("details_missing"),
    )


def hit_rate_tenths(cached: Column, uncached: Column) -> Column:
    """Cached share of the input in tenths of a percent, half up, at most 1000."""
    part, whole = cached.cast("decimal(30,0)"), (cached + uncached).cast("decimal(30,0)")
    # (2000 part + whole) div (2 whole) is the half-up quotient in integers.
    doubled = part * F.lit(2000).cast("decimal(4,0)") + whole
    rounded = F.call_function("div", doubled, whole * F.lit(2).cast("decimal(1,0)"))
    return F.when(whole > 0, F.least(rounded, F.lit(1000).cast("bigint")))


def cache_hit_rate(volumes: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = volumes.groupBy(*keys).agg(F.sum("cached").alias("_c"), F.sum("uncached").alias("_u"))
    return sums.select(*keys, hit_rate_tenths(F.col("_c"), F.col("_u")).alias("hit_tenths"))
