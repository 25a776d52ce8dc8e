"""Quota snapshots: newest reading, window roles, freshness and the period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import (
    HEALTHY_MIN_REMAINING,
    SHORT_WINDOW_MAX_SECONDS,
    WARNING_MIN_REMAINING,
)

NANOS = 1_000_000_000


def rate_limit_observations(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("limits").isNotNull() & F.col("ts_nanos").isNotNull()).select(
        "home",
        "path",
        "line_no",
        "ts_nanos",
        F.col("limits.primary").alias("primary"),
        F.col("limits.secondary").alias("secondary"),
        F.col("limits.plan_type").alias("plan_type"),
    )


def latest_quota(observations: DataFrame, live_files: DataFrame | None = None) -> DataFrame:
    """Newest reading per account; on equal times the later line wins.

    With ``live_files`` only readings of files that still exist count. Each
    file is reduced to its newest reading map-side before anything is joined.
    """
    fields = ("ts_nanos", "path", "line_no", "primary", "secondary", "plan_type")

    def newest(rows: DataFrame, *keys: str) -> DataFrame:
        pick = F.max_by(F.struct(*fields), F.struct("ts_nanos", "path", "line_no")).alias("_n")
        grouped = rows.groupBy(*keys).agg(pick)
        return grouped.select("home", "_n.*")

    if live_files is None:
        return newest(observations, "home")
    per_file = observations.withColumn("_file", F.col("path"))
    kept = newest(per_file, "home", "_file").join(live_files.select("home", "path"), ["home", "path"], "left_semi")
    return newest(kept, "home")


def merge_snapshots(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Newer ``ts_nanos`` replaces, ties go to ``newer``; an absent plan keeps
    the one known before."""
    a = older.select("home", F.struct("ts_nanos", "primary", "secondary", "plan_type").alias("_a"))
    b = newer.select("home", F.struct("ts_nanos", "primary", "secondary", "plan_type").alias("_b"))
    both = a.join(b, "home", "full_outer")
    take_new = F.col("_a").isNull() | (F.col("_b.ts_nanos") >= F.col("_a.ts_nanos"))
    chosen = F.when(F.coalesce(take_new, F.lit(False)), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_c", chosen).select(
        "home",
        "_c.ts_nanos",
        "_c.primary",
        "_c.secondary",
        F.when(F.coalesce(take_new, F.lit(False)), F.coalesce("_b.plan_type", "_a.plan_type"))
        .otherwise(F.col("_a.plan_type"))
        .alias("plan_type"),
    )


def _window(raw: Column) -> Column:
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw.getField("used_percent").alias("used_percent"),
            (raw.getField("window_minutes") * 60).cast("bigint").alias("seconds"),
            raw.getField("resets_at").cast("bigint").alias("resets_at"),
        ),
    )


def assign_windows(snapshots: DataFrame) -> DataFrame:
    """Add ``short`` and ``long`` windows.

    A negative reset in either window voids the snapshot. A single window is
    the short one up to a day; of two, the shorter is the short one.
    """
    valid = (F.col("primary.resets_at") >= 0) & (
        F.col("secondary").isNull() | (F.col("secondary.resets_at") >= 0)
    )
    first, second = _window(F.col("primary")), _window(F.col("secondary"))
    lone_short = second.isNull() & (first["seconds"] <= SHORT_WINDOW_MAX_SECONDS)
    lone_long = second.isNull() & (first["seconds"] > SHORT_WINDOW_MAX_SECONDS)
    in_order = first["seconds"] <= second["seconds"]
    return (
        snapshots.where(valid)
        .withColumn("short", F.when(lone_short | in_order, first).when(~lone_long, second))
        .withColumn("long", F.when(lone_long, first).when(in_order, second).when(~lone_short, first))
    )


def remaining(window: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - window["used_percent"]))


def colour(left: Column) -> Column:
    return (
        F.when(left >= HEALTHY_MIN_REMAINING, "healthy")
        .when(left >= WARNING_MIN_REMAINING, "warning")
        .when(left.isNotNull(), "critical")
    )


def is_expired(window: Column, now_nanos: Column) -> Column:
    return window["resets_at"] <= F.call_function("div", now_nanos, F.lit(NANOS))


def is_stale(received_nanos: Column, now_nanos: Column, refresh_seconds: int) -> Column:
    return now_nanos - received_nanos > F.lit(2 * int(refresh_seconds) * NANOS)


def quota_status(snapshots: DataFrame, now_nanos: Column, refresh_seconds: int) -> DataFrame:
    """Add what a reader at ``now`` may believe of each snapshot.

    ``stale``; per window its display state, remaining share and colour;
    ``blocked`` (an active window is used up); the headline number.
    """
    df = assign_windows(snapshots)
    df = df.withColumn("stale", is_stale(F.col("ts_nanos"), now_nanos, refresh_seconds))
    for role in ("short", "long"):
        window = F.col(role)
        gone = is_expired(window, now_nanos)
        df = df.withColumn(
            f"{role}_active", F.when(window.isNotNull() & ~gone, window)
        ).withColumn(
            f"{role}_state",
            F.when(F.col("stale") | window.isNull(), "unknown").when(gone, "updating").otherwise("ready"),
        )
        left = remaining(F.col(f"{role}_active"))
        df = df.withColumn(f"{role}_remaining", F.when(F.col(f"{role}_active").isNotNull(), left))
        df = df.withColumn(f"{role}_colour", colour(F.col(f"{role}_remaining")))
    df = df.withColumn(
        "blocked",
        F.coalesce(F.col("short_remaining") <= 0, F.lit(False))
        | F.coalesce(F.col("long_remaining") <= 0, F.lit(False)),
    )
    shown = F.coalesce("short_remaining", "long_remaining")
    return df.withColumn(
        "headline",
        F.when(F.col("stale") | shown.isNull(), F.lit(None).cast("double"))
        .when(F.col("blocked"), F.lit(0.0))
        .otherwise(shown),
    )


def period_boundary(status: DataFrame) -> DataFrame:
    """Start of the current quota period: reset minus duration of the active
    long window of a fresh snapshot; NULL when there is none."""
    start = F.col("long_active.resets_at") - F.col("long_active.seconds")
    return status.withColumn(
        "period_start_nanos", F.when(~F.col("stale") & (start >= 0), start * F.lit(NANOS))
    )


def next_pull_delay(status: DataFrame, now_nanos: Column, refresh_seconds: int) -> DataFrame:
    """Seconds until a fresh snapshot is due: the interval since the last one,
    or the next window reset when that comes first."""
    age = F.greatest(F.lit(0), now_nanos - F.col("ts_nanos")) / F.lit(NANOS)
    fresh_for = F.greatest(F.lit(0.0), F.lit(float(refresh_seconds)) - age)
    reset = F.least("primary.resets_at", "secondary.resets_at") - now_nanos / F.lit(NANOS)
    return status.withColumn("pull_in_seconds", F.least(fresh_for, F.greatest(F.lit(0.0), reset)))
