"""Usage volumes priced against a price table, with "unknown stays unknown".

A price table has one row per model and tier:
``model, tier, is_split, short STRUCT<input,cached_input,output>, long STRUCT``.
A flat row answers every context band; a split row answers ``short``, answers
``long`` only when it has long prices, and cannot answer ``unknown``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.blocks import join_dimension

RATES = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("input", "cached_input", "output")]
)
PRICES = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("is_split", T.BooleanType()),
        T.StructField("short", RATES),
        T.StructField("long", RATES),
    ]
)
TOKEN_KINDS = ("uncached", "cached", "output")


def price_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), PRICES)


def release_base(model: Column) -> Column:
    """``name-YYYY-MM-DD`` without its date; NULL when the date is no date."""
    pattern = r"^(.+)-(\d{4}-\d{2}-\d{2})$"
    base = F.regexp_extract(model, pattern, 1)
    day = F.try_to_date(F.regexp_extract(model, pattern, 2), "yyyy-MM-dd")
    return F.when((base != "") & day.isNotNull(), base)


def by_model(prices: DataFrame) -> DataFrame:
    """One row per model, its tiers in a map (at most three entries)."""
    entry = F.struct("tier", F.struct("is_split", "short", "long"))
    return prices.groupBy("model").agg(F.map_from_entries(F.collect_set(entry)).alias("tiers"))


def look_up(
    items: DataFrame, prices: DataFrame, tier: Column, spread_by: Sequence[str]
) -> DataFrame:
    """Add ``price_rates`` and ``price_error`` for ``model``, ``tier``, ``band``.

    The model is settled first (exact name, else its undated base), then the
    tier, then the band: a dated entry that lacks a tier does not fall back.
    """
    models = by_model(prices)
    found = join_dimension(
        items.withColumn("_base", release_base(F.col("model"))),
        models.withColumnRenamed("tiers", "_exact"),
        ["model"],
        spread_by,
    )
    found = join_dimension(
        found,
        models.select(F.col("model").alias("_base"), F.col("tiers").alias("_dated")),
        ["_base"],
        spread_by,
    )
    found = found.withColumn("_tiers", F.coalesce("_exact", "_dated")).withColumn(
        "_price", F.try_element_at(F.col("_tiers"), tier)
    )
    split, long_rates = F.col("_price.is_split"), F.col("_price.long")
    error = (
        F.when(F.col("_tiers").isNull(), "model")
        .when(F.col("_price").isNull(), "tier")
        .when(split & (F.col("band") == "long") & long_rates.isNull(), "context")
        .when(split & (F.col("band") == "unknown"), "context_unknown")
    )
    rates = F.when(
        error.isNull(), F.when(split & (F.col("band") == "long"), long_rates).otherwise(F.col("_price.short"))
    )
    return (
        found.withColumn("price_error", error)
        .withColumn("price_rates", rates)
        .drop("_base", "_exact", "_dated", "_tiers", "_price")
    )


def price_volumes(
    volumes: DataFrame, prices: DataFrame, spread_by: Sequence[str] = ("home",)
) -> DataFrame:
    """Add ``cost`` or the reason there is none.

    ``issue_kind`` is ``gap`` (a price is missing, a newer sheet may have it)
    or ``diagnostic`` (the log lacks what pricing needs); ``issue`` names it.
    Rows without tokens cost nothing and raise nothing. A NULL tier is priced
    as standard; a missing rate matters only for tokens that need it.
    """
    tier = F.coalesce("tier_kind", F.lit("standard"))
    found = look_up(volumes, prices, tier, spread_by)
    used = F.col("details_missing") | (
        (F.col("uncached") != 0) | (F.col("cached") != 0) | (F.col("output") != 0)
    )
    rates = dict(zip(TOKEN_KINDS, ("input", "cached_input", "output"), strict=True))
    missing_rate = F.coalesce(
        *[
            F.when((F.col(kind) != 0) & F.col(f"price_rates.{rate}").isNull(), rate)
            for kind, rate in rates.items()
        ]
    )
    diagnostic = (
        F.when(F.col("details_missing"), "details_missing")
        .when(tier == "unknown", "unknown_tier")
        .when(F.col("model").isNull(), "model_missing")
        .when(F.col("price_error") == "context_unknown", "context_unknown")
    )
    gap = F.coalesce(F.col("price_error"), missing_rate)
    found = found.withColumn("issue", F.when(used, F.coalesce(diagnostic, gap))).withColumn(
        "issue_kind",
        F.when(used & diagnostic.isNotNull(), "diagnostic").when(used & gap.isNotNull(), "gap"),
    )
    cost = sum(
        (
            F.when(F.col(kind) != 0, F.col(kind).cast("double") * F.col(f"price_rates.{rate}") / 1e6)
            .otherwise(F.lit(0.0))
            for kind, rate in rates.items()
        ),
        F.lit(0.0),
    )
    return found.withColumn("cost", F.when(F.col("issue").isNull(), cost)).drop(
        "price_error", "price_rates"
    )


def strict_cost(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost per key, NULL as soon as one bucket with tokens has no price."""
    return priced.groupBy(*keys).agg(
        F.when(F.count("issue") > 0, F.lit(None).cast("double"))
        .otherwise(F.sum("cost"))
        .alias("cost")
    )


def price_issues(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct gaps and diagnostics per key."""
    return (
        priced.where(F.col("issue").isNotNull())
        .select(
            *keys,
            "issue_kind",
            "model",
            F.when(F.col("issue_kind") == "gap", F.coalesce("tier_kind", F.lit("standard")))
            .when(F.col("issue") == "unknown_tier", F.col("tier_text"))
            .when(F.col("issue") == "context_unknown", F.coalesce("tier_kind", F.lit("standard")))
            .alias("tier"),
            F.when(F.col("issue_kind") == "gap", F.col("band")).alias("band"),
            "issue",
        )
        .distinct()
    )


def gaps_resolved(gaps: DataFrame, prices: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Add ``resolved``: the price a stored gap waits for now exists."""
    found = look_up(gaps, prices, F.col("tier"), spread_by)
    whole = F.col("issue").isin("model", "tier", "context")
    rate = (
        F.when(F.col("issue") == "input", F.col("price_rates.input"))
        .when(F.col("issue") == "cached_input", F.col("price_rates.cached_input"))
        .when(F.col("issue") == "output", F.col("price_rates.output"))
    )
    ok = F.col("price_rates").isNotNull() & (whole | rate.isNotNull())
    return found.withColumn("resolved", F.coalesce(ok, F.lit(False))).drop(
        "price_error", "price_rates"
    )
