"""Life of a price gap: seen, still missing, given up, filled, seen again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import GAP_RETRY_SECONDS
from tallyspark.operators.pricing import gaps_resolved

GAP = ("home", "model", "tier", "band", "issue")
RETRY_NANOS = GAP_RETRY_SECONDS * 1_000_000_000


def follow_gaps(state: DataFrame, current: DataFrame, prices: DataFrame, now_nanos: Column) -> DataFrame:
    """One step over all gaps, old and new.

    ``state``: ``GAP, first_seen, gave_up``. ``current``: gaps of this run.
    Returns every gap with ``event`` (``missing``, ``gave_up``, ``resolved``
    or NULL) and its next ``first_seen, gave_up, open``. Rows with ``open``
    are the next state; a filled gap leaves it and may be reported afresh.
    """
    old = state.select(*GAP, "first_seen", "gave_up")
    seen = current.select(*GAP).distinct().withColumn("_now", F.lit(True))
    both = gaps_resolved(old.join(seen, list(GAP), "full_outer"), prices, GAP)
    known, present = F.col("first_seen").isNotNull(), F.coalesce("_now", F.lit(False))
    filled = known & F.col("resolved") & ~present
    late = known & ~filled & ~F.coalesce("gave_up", F.lit(False)) & (now_nanos - F.col("first_seen") >= F.lit(RETRY_NANOS))
    return both.select(
        *GAP,
        F.when(filled, "resolved").when(late, "gave_up").when(present & ~known, "missing").alias("event"),
        F.coalesce(F.col("first_seen"), now_nanos).alias("first_seen"),
        (F.coalesce("gave_up", F.lit(False)) | late).alias("gave_up"),
        (~filled).alias("open"),
    )


def next_state(followed: DataFrame) -> DataFrame:
    return followed.where("open").select(*GAP, "first_seen", "gave_up")


def wants_new_sheet(followed: DataFrame) -> DataFrame:
    """Accounts with a gap worth fetching a newer sheet for."""
    return followed.where(F.col("open") & ~F.col("gave_up")).select("home").distinct()


def new_diagnostics(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Diagnostics not present in the run before; each is reported once."""
    key = [c for c in current.columns]
    condition = [previous[c].eqNullSafe(current[c]) for c in key]
    return current.join(previous, condition, "left_anti").distinct()
