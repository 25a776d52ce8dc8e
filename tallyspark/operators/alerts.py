"""Alert rules over a stored series of snapshots (batch form).

The streaming processor in ``streaming.alerts`` applies the full rules while
observations arrive; these forms find the same events in history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import (
    BALANCE_EPSILON,
    MIN_BLIND_GAP_SECONDS,
    OVERFLOW_ALERT_CREDITS,
    RESET_DRIFT_SHARE,
    RESTORED_MAX_USED,
    RESTORED_MIN_DROP,
)
from tallyspark.operators.blocks import ordered_slices, running
from tallyspark.operators.quota import NANOS, assign_windows, is_expired, remaining

ORDER = ("ts_nanos", "path", "line_no")
ROLES = ("short", "long")


def blind_gap_nanos(refresh_seconds: int) -> int:
    """Longest gap between readings that still counts as watching."""
    return max(MIN_BLIND_GAP_SECONDS, 2 * int(refresh_seconds)) * NANOS


def is_window_reset(previous: Column, following: Column) -> Column:
    """The reset time moved on by one window length, give or take a tenth."""
    drift = F.abs(following["resets_at"] - (previous["resets_at"] + previous["seconds"]))
    return (previous["seconds"] == following["seconds"]) & (
        drift <= previous["seconds"] * RESET_DRIFT_SHARE
    )


def _series(observations: DataFrame) -> DataFrame:
    rows = assign_windows(observations)
    used_up = F.lit(False)
    for role in ROLES:
        active = F.col(role).isNotNull() & ~is_expired(F.col(role), F.col("ts_nanos"))
        used_up = used_up | F.coalesce(active & (remaining(F.col(role)) <= 0), F.lit(False))
    extra = [c for c in ("account_id",) if c in observations.columns]
    return rows.select("home", *ORDER, *ROLES, used_up.alias("blocked"), *extra)


def _events(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    entries = [
        F.struct(F.lit(r).alias("window"), F.coalesce(found[r], F.lit(False)).alias("hit"), F.col(r).alias("next"))
        for r in ROLES
    ]
    hits = rows.withColumn("_e", F.explode(F.filter(F.array(*entries), lambda e: e.getField("hit"))))
    return hits.select(
        "home", *ORDER, "_e.window", F.col("_e.next.seconds").alias("seconds"),
        F.col("_e.next.resets_at").alias("resets_at"), remaining(F.col("_e.next")).alias("remaining"),
    )


def reset_events(observations: DataFrame, refresh_seconds: int) -> DataFrame:
    """Readings at which a window had just been replaced by the next one.

    The comparison uses the latest reset seen so far, so an old record written
    late does not fire again.
    """
    rows = ordered_slices(_series(observations), ["home"], ORDER)
    rows = running(
        rows, ["home"], ORDER,
        {
            "_before": ("last", F.struct("ts_nanos", *ROLES), False),
            "_short": ("max", F.col("short.resets_at"), False),
            "_long": ("max", F.col("long.resets_at"), False),
        },
    )
    gap = F.col("ts_nanos") - F.col("_before.ts_nanos")
    watching = (gap > 0) & (gap <= blind_gap_nanos(refresh_seconds)) & ~F.col("blocked")
    found = {}
    for role in ROLES:
        baseline = F.struct(
            F.col(f"_before.{role}.seconds").alias("seconds"), F.col(f"_{role}").alias("resets_at")
        )
        found[role] = watching & is_window_reset(baseline, F.col(role))
    return _events(rows, found)


def early_restores(observations: DataFrame, refresh_seconds: int) -> DataFrame:
    """Authenticated readings whose used share fell back before the reset."""
    rows = ordered_slices(_series(observations), ["home"], ORDER)
    known = F.col("account_id").isNotNull()
    rows = running(
        rows, ["home"], ORDER,
        {
            "_seen": ("last", F.col("ts_nanos"), False),
            "_before": ("last", F.when(known, F.struct("ts_nanos", "account_id", *ROLES)), False),
        },
    )
    limit = blind_gap_nanos(refresh_seconds)
    gap = F.col("ts_nanos") - F.col("_before.ts_nanos")
    watching = (
        known & (F.col("account_id") == F.col("_before.account_id")) & (gap > 0) & (gap <= limit)
        & (F.col("ts_nanos") - F.col("_seen") <= limit) & ~F.col("blocked")
    )
    found = {}
    for role in ROLES:
        old, new = F.col(f"_before.{role}"), F.col(role)
        found[role] = (
            watching
            & (old["seconds"] == new["seconds"])
            & ~is_window_reset(old, new)
            & ~is_expired(new, F.col("ts_nanos"))
            & old["used_percent"].between(0.0, 100.0)
            & new["used_percent"].between(0.0, RESTORED_MAX_USED)
            & (old["used_percent"] - new["used_percent"] >= RESTORED_MIN_DROP)
            & (new["resets_at"] >= old["resets_at"])
        )
    return _events(rows, found)


def overflow_alerts(readings: DataFrame, refresh_seconds: int) -> DataFrame:
    """First reading of a quota period at which credits had begun to flow.

    ``readings``: ``home, ts_nanos, path, line_no, period, balance``. Spending
    must have been seen below the threshold earlier in the same period and in
    the same unbroken stretch of watching; each period alerts once.
    """
    rows = ordered_slices(readings.select("home", *ORDER, "period", "balance"), ["home"], ORDER)
    rows = running(rows, ["home"], ORDER, {"_before": ("last", F.struct("ts_nanos", "period", "balance"), False)})
    same = F.col("_before.period") == F.col("period")
    drop = F.col("_before.balance") - F.col("balance")
    broken = F.coalesce(F.col("ts_nanos") - F.col("_before.ts_nanos") > blind_gap_nanos(refresh_seconds), F.lit(True))
    rows = rows.select(
        "home", *ORDER, "period", "block",
        F.when(F.coalesce(same & (drop > BALANCE_EPSILON), F.lit(False)), drop).otherwise(0.0).alias("_fall"),
        broken.cast("bigint").alias("_break"),
    )
    rows = running(
        rows, ["home", "period"], ORDER,
        {"credits": ("sum", F.col("_fall"), True), "_stretch": ("sum", F.col("_break"), True)},
    )
    low = F.col("credits") < OVERFLOW_ALERT_CREDITS
    rows = running(rows, ["home", "period", "_stretch"], ORDER, {"_armed": ("max", low, False)})
    firing = rows.where(~low & F.coalesce("_armed", F.lit(False)))
    first = firing.groupBy("home", "period").agg(
        F.min(F.struct(*ORDER, "credits")).alias("_f")
    )
    return first.select("home", "period", F.col("_f.ts_nanos").alias("ts_nanos"), F.col("_f.credits").alias("credits"))


def merge_messages(alerts: DataFrame) -> DataFrame:
    """One message per observation and kind: ``home, ts_nanos, kind, rank,
    body`` with the bodies of one observation joined in window order."""
    parts = F.sort_array(F.collect_list(F.struct("rank", "body")))
    return alerts.groupBy("home", "ts_nanos", "kind").agg(
        F.array_join(F.transform(parts, lambda p: p.getField("body")), "；").alias("body")
    )
