"""Settings carried down a session log: current model and service tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.blocks import carry_into_blocks, last_known, spread_over_blocks, upto, within_block

FILE = ("home", "path")


def carry_settings(lines: DataFrame, keys: Sequence[str] = FILE, state: DataFrame | None = None) -> DataFrame:
    """Add ``model``, ``tier_kind``, ``tier_text`` in force at every line.

    ``state``: per file the ``model`` and ``tier`` that earlier lines left (see
    ``streaming.parse_table``).

    Input columns: ``model_set`` (NULL when the line names no model),
    ``sets_tier`` and the ``tier_set_kind``/``tier_set_text`` it sets. A line
    may set the tier to NULL, which clears it; the struct wrapper keeps that
    explicit NULL apart from "not mentioned".
    """
    tier = F.struct(
        F.col("tier_set_kind").alias("kind"), F.col("tier_set_text").alias("text")
    )
    marked = lines.withColumn("_tier", F.when(F.col("sets_tier"), tier))
    ends = marked.groupBy(*keys, "block").agg(
        F.max(F.when(F.col("model_set").isNotNull(), F.struct("line_no", "model_set"))).alias("_m"),
        F.max(F.when(F.col("_tier").isNotNull(), F.struct("line_no", "_tier"))).alias("_t"),
    )
    carried = carry_into_blocks(
        ends.select(
            *keys,
            "block",
            F.col("_m.model_set").alias("_end_model"),
            F.col("_t._tier").alias("_end_tier"),
        ),
        keys,
        {"_in_model": last_known("_end_model"), "_in_tier": last_known("_end_tier")},
    )
    spec = upto(within_block(keys))
    local = marked.select(
        *lines.columns,
        F.last("model_set", ignorenulls=True).over(spec).alias("_model"),
        F.last("_tier", ignorenulls=True).over(spec).alias("_tier"),
    )
    joined = local.join(carried, [*keys, "block"], "left")
    if state is not None:
        earlier = state.select(*keys, F.col("model").alias("_s_model"), F.col("tier").alias("_s_tier"))
        joined = joined.join(spread_over_blocks(earlier, lines, keys), [*keys, "block"], "left")
        joined = joined.withColumns({"_in_model": F.coalesce("_in_model", "_s_model"), "_in_tier": F.coalesce("_in_tier", "_s_tier")})
    tier_now = F.coalesce("_tier", "_in_tier")
    return joined.select(
        *lines.columns,
        F.coalesce("_model", "_in_model").alias("model"),
        tier_now.getField("kind").alias("tier_kind"),
        tier_now.getField("text").alias("tier_text"),
    )
