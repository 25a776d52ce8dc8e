"""From parsed lines and a file table to one report row per account."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import USD_PER_CREDIT
from tallyspark.functions import display
from tallyspark.functions.counters import CounterMath
from tallyspark.operators.blocks import join_dimension
from tallyspark.operators.carry import FILE
from tallyspark.operators.forks import parent_state, replay_bounds
from tallyspark.operators.pricing import price_issues, price_volumes, strict_cost
from tallyspark.operators.quota import (
    latest_quota,
    merge_snapshots,
    period_boundary,
    quota_status,
    rate_limit_observations,
)
from tallyspark.operators.threads import file_profile
from tallyspark.operators.timeline import token_events
from tallyspark.operators.usage import cache_hit_rate
from tallyspark.operators.windows import (
    file_buckets,
    judge_files,
    local_date,
    select_files,
    settle_threads,
    tallied_buckets,
    window_credits,
    window_reliability,
    window_totals,
    window_volumes,
)
from tallyspark.session import settle

EVENT_COLUMNS = (
    "home", "path", "block", "line_no", "ts_nanos", "sig", "model", "tier_kind", "tier_text", "band",
    "overflow", "details_missing", "delta_total", "delta_uncached", "delta_cached", "delta_output",
)


@dataclass
class UsageTables:
    """Results of one report run; every member is a lazy table."""

    events: DataFrame
    files: DataFrame
    status: DataFrame
    judged: DataFrame
    roles: DataFrame
    reliability: DataFrame
    totals: DataFrame
    volumes: DataFrame
    credits: DataFrame


def fork_outcome(files: DataFrame, events: DataFrame) -> DataFrame:
    """Per file: may its timeline be counted (``replay_ok``), and up to which
    line it only replays its parent (``replay_line_no``)."""
    children = files.where(F.col("parent_kind") == "parent").select(*FILE, "parent_id", "root_ts")
    judged, parents = parent_state(children, files, events)
    judged = settle(judged)
    bounds = replay_bounds(judged.where("usable"), parents, events)
    outcome = judged.join(
        bounds.select("home", F.col("fork").alias("path"), "replay_line_no"), list(FILE), "left"
    ).select(*FILE, F.col("usable").alias("_usable"), "replay_line_no")
    return files.join(outcome, list(FILE), "left").withColumn(
        "replay_ok",
        F.when(F.col("parent_kind") == "none", F.lit(True)).otherwise(F.coalesce("_usable", F.lit(False))),
    ).drop("_usable")


def usage_tables(
    lines: DataFrame,
    files: DataFrame,
    now: Column,
    tz: str,
    refresh_seconds: int,
    snapshots: DataFrame | None = None,
    discovery: DataFrame | None = None,
) -> UsageTables:
    """Run the usage side of the report.

    ``lines``: parsed log lines with ``block``. ``files``: one row per listed
    file (see ``sources.session_logs.file_table``). ``snapshots``: readings
    fetched from the service, merged with those found in the logs.
    ``discovery``: ``home, errors`` of the log scan.
    """
    today = local_date(now, tz)
    events = settle(token_events(lines).select(*EVENT_COLUMNS))
    # Readings count whatever the provider, as long as their file is listed.
    newest = latest_quota(rate_limit_observations(lines), files)
    if snapshots is not None:
        newest = merge_snapshots(newest, snapshots)
    status = settle(period_boundary(quota_status(newest, now, refresh_seconds)))

    boundary = status.select("home", "period_start_nanos").withColumn(
        "period_start_date", local_date(F.col("period_start_nanos"), tz)
    )
    profiled = files.join(file_profile(events), list(FILE), "left").withColumn(
        "n_events", F.coalesce("n_events", F.lit(0).cast("bigint"))
    )
    placed = join_dimension(profiled, boundary, ["home"], ["path"])
    scoped = settle(fork_outcome(settle(placed.withColumn("root_date", local_date(F.col("root_ts"), tz))), events))

    buckets = settle(file_buckets(events, scoped, today, tz))
    judged = settle(judge_files(select_files(scoped, buckets, today)))
    roles = settle(settle_threads(judged, events))
    homes = files.select("home").distinct()
    if discovery is None:
        homes = homes.withColumn("discovery_errors", F.lit(0).cast("bigint"))
    else:
        homes = homes.join(discovery.select("home", F.col("errors").alias("discovery_errors")), "home", "full_outer")
    homes = homes.join(boundary, "home", "left")
    tallied = settle(tallied_buckets(buckets, roles))
    balances = lines.where(F.col("balance").isNotNull() & F.col("ts_nanos").isNotNull()).select(
        *FILE, "block", "line_no", "ts_nanos", "balance"
    )
    return UsageTables(
        events=events,
        files=scoped,
        status=status,
        judged=judged,
        roles=roles,
        reliability=settle(window_reliability(judged, roles, homes)),
        totals=window_totals(tallied),
        volumes=settle(window_volumes(tallied)),
        credits=window_credits(balances, scoped, roles, today, tz),
    )


def have_prices(prices: DataFrame) -> Column:
    """Whether there is any price at all, as a scalar subquery."""
    return prices.agg(F.count(F.lit(1)) > 0).scalar()


def window_report(tables: UsageTables, prices: DataFrame) -> DataFrame:
    """One row per account and window; values stay NULL unless reliable."""
    key = ["home", "window_kind"]
    cost = strict_cost(price_volumes(tables.volumes, prices), key).withColumnRenamed("cost", "_cost")
    df = (
        tables.reliability.join(tables.totals, key, "left")
        .join(tables.credits, key, "left")
        .join(cost.withColumn("_has_volume", F.lit(True)), key, "left")
        .join(cache_hit_rate(tables.volumes, key), key, "left")
        .withColumn("_priced", have_prices(prices))
    )
    zero = CounterMath.of(tables.totals, "tokens").zero()
    # No usage costs nothing, provided there is a price table at all.
    settled_cost = F.when(
        F.col("_priced"), F.when(F.col("_has_volume"), F.col("_cost")).otherwise(F.lit(0.0))
    )
    values = {
        "tokens": F.coalesce("tokens", zero),
        "overflow_tokens": F.coalesce("overflow_tokens", zero),
        "credits_spent": F.coalesce("credits_spent", F.lit(0.0)),
        "overflow_usd": F.coalesce("credits_spent", F.lit(0.0)) * USD_PER_CREDIT,
        "cost": settled_cost,
        "hit_tenths": F.col("hit_tenths"),
    }
    out = df.select(
        *key, "reliable", "deferred_files", *[F.when(F.col("reliable"), v).alias(n) for n, v in values.items()]
    )
    return out.withColumn(
        "overflow_visible",
        F.coalesce(F.col("overflow_tokens") > 0, F.lit(False)) | F.coalesce(F.col("overflow_usd") > 0, F.lit(False)),
    )


def _saturated(value: Column, math: CounterMath) -> Column:
    """A rounded DOUBLE as a counter, at most the largest one."""
    if math.wide:
        return math.clamp(value.cast("decimal(38,0)"))
    return F.when(value.isNotNull(), F.coalesce(value.try_cast("bigint"), F.lit(2**63 - 1)))


def usage_report(tables: UsageTables, prices: DataFrame, tz: str, style: str = "zh") -> DataFrame:
    """The account report: both windows, quota state, estimates and texts."""
    wide = window_report(tables, prices)
    math = CounterMath.of(wide, "tokens")
    names = ("reliable", "tokens", "overflow_tokens", "credits_spent", "overflow_usd", "cost", "hit_tenths", "overflow_visible")
    per_home = wide.groupBy("home").agg(
        *[
            F.max(F.when(F.col("window_kind") == w, F.col(n))).alias(f"{w}_{n}")
            for w in ("today", "period")
            for n in names
        ],
        F.sum("deferred_files").alias("deferred_files"),
    )
    df = per_home.join(
        tables.status.select(
            "home", "ts_nanos", "plan_type", "stale", "blocked", "headline", "short", "long",
            "short_state", "long_state", "short_remaining", "long_remaining", "long_active",
        ),
        "home",
        "left",
    )
    used = F.when(~F.col("stale"), F.col("long_active.used_percent"))
    df = df.withColumn(
        "period_value_estimate",
        F.when((used >= 1.0) & (F.col("period_cost") > 0), F.col("period_cost") * 100.0 / used),
    ).withColumn(
        "period_token_estimate",
        F.when((used >= 1.0) & (F.col("period_tokens") > 0), _saturated(F.round(F.col("period_tokens") * 100.0 / used), math)),
    )
    plan, long_seconds = F.col("plan_type"), F.col("long.seconds")
    shown_long = F.when(~F.col("stale"), F.when(F.col("long_active").isNotNull(), long_seconds))
    return df.select(
        *[c for c in df.columns if c not in ("short", "long", "long_active")],
        display.usage_with_hit(F.col("today_tokens"), F.col("today_hit_tenths"), style).alias("today_text"),
        display.usage_with_hit(F.col("period_tokens"), F.col("period_hit_tenths"), style).alias("period_text"),
        display.usd(F.col("today_cost")).alias("today_cost_text"),
        display.usd(F.col("period_cost")).alias("period_cost_text"),
        display.usd(F.col("period_value_estimate")).alias("estimate_text"),
        display.period_label(shown_long, plan).alias("period_label"),
        display.plan_label(plan).alias("plan_label"),
        display.plan_class(plan).alias("plan_class"),
        display.reset_column(F.col("long.resets_at"), F.lit(0), tz).alias("long_reset_text"),
    )


def report_issues(tables: UsageTables, prices: DataFrame) -> DataFrame:
    """Price gaps and diagnostics of the windows that can be trusted."""
    key = ["home", "window_kind"]
    trusted = tables.reliability.where("reliable").select(*key)
    issues = price_issues(price_volumes(tables.volumes.join(trusted, key, "left_semi"), prices), ["home"])
    # Without any price table a missing price says nothing.
    return issues.where(have_prices(prices) | (F.col("issue_kind") == "diagnostic"))


def run_diagnostics(tables: UsageTables) -> DataFrame:
    """What one run looked at, per account: files, events, errors, deferrals."""
    files = tables.files.groupBy("home").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if("uncertain").alias("files_uncertain"),
        F.sum("n_events").alias("token_events"),
    )
    selected = tables.judged.groupBy("home").agg(
        F.count_distinct("path").alias("files_selected"),
        F.count_if(~F.col("verdict").isin("counted", "ignored")).alias("files_refused"),
    )
    copies = tables.roles.groupBy("home").agg(F.count_distinct(F.when(F.col("role") == "copy", F.col("path"))).alias("copies"))
    deferred = tables.reliability.groupBy("home").agg(F.sum("deferred_files").alias("deferred_files"))
    df = files
    for part in (selected, copies, deferred):
        df = df.join(part, "home", "left")
    return df.na.fill(0)
