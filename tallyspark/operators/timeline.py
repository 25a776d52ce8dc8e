"""Lines to priced-ready token events in one chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.counters import context_band, details_missing
from tallyspark.operators.carry import FILE, carry_settings
from tallyspark.operators.deltas import flatten_events, token_timeline
from tallyspark.session import settle


def flat_events(lines: DataFrame, keys: Sequence[str] = FILE, state: DataFrame | None = None) -> DataFrame:
    """Token events with their settings, as ``token_timeline`` takes them."""
    settled = carry_settings(lines, keys, state).where("is_token")
    own = settled.select(
        *settled.columns,
        context_band(F.col("last")).alias("band"),
        details_missing(F.col("total"), F.col("last")).alias("details_missing"),
    )
    return flatten_events(own).drop("model_set", "sets_tier", "tier_set_kind", "tier_set_text", "limits")


def token_events(lines: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Token events with model, tier, deltas, overflow, band and detail flag.

    The events with their settings are written once: the timeline's branches
    (rows, block ends, source peaks) each read a few columns of that table
    instead of parsing the logs again.
    """
    return token_timeline(settle(flat_events(lines, keys)), keys)
