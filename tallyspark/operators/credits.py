"""Credits spent: the falls of an account's balance over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import BALANCE_EPSILON
from tallyspark.operators.blocks import fold_neighbours


def credits_debits(
    balances: DataFrame, keys: Sequence[str] = ("home",), windows: Sequence[str] = ("in_window",)
) -> DataFrame:
    """Sum the falls between neighbouring balance readings of an account.

    ``balances``: ``keys, ts_nanos, path, line_no, balance`` and one boolean
    per window. A fall counts in a window only when both readings lie in it;
    rises (grants) never count. Equal readings of parallel sessions sit next
    to each other after ordering and cancel. Adds ``spent_<window>``.
    """

    def fall(window):
        def step(previous, row):
            drop = previous["balance"] - row["balance"]
            counts = (drop > BALANCE_EPSILON) & previous[window] & row[window]
            return F.when(counts, drop).otherwise(F.lit(0.0))

        return step

    return fold_neighbours(
        balances,
        keys,
        ("ts_nanos", "path", "line_no"),
        ("balance", *windows),
        {f"spent_{window}": fall(window) for window in windows},
    )
