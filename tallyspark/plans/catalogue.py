"""Registered queries: each one runs an operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import display
from tallyspark.operators.alerts import early_restores, merge_messages, overflow_alerts, reset_events
from tallyspark.operators.carry import carry_settings
from tallyspark.operators.compaction import compact_events, compactable_files
from tallyspark.operators.credits import credits_debits
from tallyspark.operators.pricing import price_frame, price_issues, price_volumes, strict_cost
from tallyspark.operators.quota import (
    NANOS,
    latest_quota,
    merge_snapshots,
    period_boundary,
    quota_status,
    rate_limit_observations,
)
from tallyspark.operators.blocks import dense_positions, join_dimension
from tallyspark.operators.deltas import DELTAS
from tallyspark.operators.timeline import token_events
from tallyspark.operators.watching import find_alerts
from tallyspark.operators.usage import cache_hit_rate, hit_rate_tenths, usage_volumes
from tallyspark.operators.windows import local_date
from tallyspark.plans.history import compact_history, refresh_outcomes, restore_history, thread_outcomes
from tallyspark.plans.refresh import Refresh, refresh
from tallyspark.plans.parameters import AS_OF_SPARK, NEWER_PRICE_ROWS, PRICE_ROWS, REFRESH_SECONDS, TZ
from tallyspark.operators.forks import ancestor_closure, parent_state, replay_bounds
from tallyspark.operators.gaps import GAP, follow_gaps
from tallyspark.operators.threads import file_profile, mark_copies, resolve_threads
from tallyspark.plans.usage_report import (
    EVENT_COLUMNS,
    UsageTables,
    run_diagnostics,
    usage_report,
    usage_tables,
    window_report,
)
from tallyspark.session import configure, scratch_folder, settle, write_settled
from tallyspark.sources.buckets import Buckets
from tallyspark.sources.byte_log import discover
from tallyspark.sources.derived_inputs import account_rows, log_text, response_rows, sheet_rows, split_snapshots
from tallyspark.sources.derived_logs import logged_lines, period_of, user_of, write_stage
from tallyspark.sources.event_feed import SPLIT_DAY, event_files, event_lines, nanos_literal
from tallyspark.sources.manifest import manifest_diff
from tallyspark.sources.price_sheets import parse_price_sheets
from tallyspark.sources.responses import parse_accounts, parse_rate_limits
from tallyspark.sources.session_logs import parse_text
from tallyspark.streaming.alerts import AlertRules, alerts_of, watch
from tallyspark.streaming.parse_table import events_of, parse_lines
from tallyspark.streaming.windows import SUMS, cut_periods, keep_slices, kept_slices
from tallyspark.streaming.parse_state import (
    OUTPUT,
    configure_streaming,
    process_lines,
    stream_lines,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register a function under a name."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        return function

    return register


def now() -> F.Column:
    return F.expr(AS_OF_SPARK)


def _events(spark: SparkSession, sf_dir: str, variants: bool = False) -> DataFrame:
    return token_events(event_lines(spark, sf_dir, variants))


def _prices(spark: SparkSession) -> DataFrame:
    return price_frame(spark, PRICE_ROWS)


def _status(lines: DataFrame) -> DataFrame:
    return quota_status(latest_quota(rate_limit_observations(lines)), now(), REFRESH_SECONDS)


def _split(events: DataFrame, *keys: str) -> DataFrame:
    def total(flag):
        return F.coalesce(F.sum(F.when(flag, F.col("delta_total"))), F.lit(0)).cast("bigint")

    return events.groupBy(*keys).agg(
        total(~F.col("overflow")).alias("tokens"),
        total(F.col("overflow")).alias("overflow_tokens"),
        F.count_if("capped").alias("capped_events"),
    )


@query("model_carry_forward")
def model_carry_forward(spark, sf_dir):
    return carry_settings(event_lines(spark, sf_dir)).select("home", "path", "line_no", "model")


@query("tier_carry_forward")
def tier_carry_forward(spark, sf_dir):
    return carry_settings(event_lines(spark, sf_dir)).select(
        "home", "path", "line_no", "tier_kind", "tier_text"
    )


@query("token_deltas")
def token_deltas(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "home", "path", "line_no", "is_duplicate", "is_stale",
        "delta_total", "delta_uncached", "delta_cached", "delta_output",
    )


@query("dedupe_audit")
def dedupe_audit(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("home", "path").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if("is_stale").alias("stale"),
    )


@query("usage_volumes")
def usage_volumes_by_home(spark, sf_dir):
    return usage_volumes(_events(spark, sf_dir), ["home"])


@query("overflow_split")
def overflow_split(spark, sf_dir):
    return _split(_events(spark, sf_dir), "home")


@query("credits_debits")
def credits_debits_by_home(spark, sf_dir):
    balances = (
        event_lines(spark, sf_dir)
        .where(F.col("balance").isNotNull() & F.col("ts_nanos").isNotNull())
        .withColumn("in_window", F.lit(True))
    )
    return credits_debits(balances).select(
        "home", F.round("spent_in_window", 4).alias("credits_spent")
    )


@query("latest_quota")
def latest_quota_by_home(spark, sf_dir):
    newest = latest_quota(rate_limit_observations(event_lines(spark, sf_dir)))
    return newest.select(
        "home", "ts_nanos", "plan_type",
        F.col("primary.used_percent").alias("short_used"),
        F.col("primary.resets_at").alias("short_resets"),
        F.col("secondary.used_percent").alias("long_used"),
        F.col("secondary.resets_at").alias("long_resets"),
    )


@query("quota_status")
def quota_status_by_home(spark, sf_dir):
    return _status(event_lines(spark, sf_dir)).select(
        "home", "stale", "short_remaining", "long_remaining", "short_state", "long_state",
        "blocked", "headline", "short_colour",
    )


@query("today_usage")
def today_usage(spark, sf_dir):
    today = F.date_format(local_date(now(), TZ), "yyyy-MM-dd")
    events = _events(spark, sf_dir)
    on_day = F.date_format(local_date(F.col("ts_nanos"), TZ), "yyyy-MM-dd") == today
    return _split(events.where(on_day), "home").drop("capped_events")


@query("period_usage")
def period_usage(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    start = period_boundary(_status(lines)).select("home", "period_start_nanos")
    # Only the account's start time travels to the events, salted by file.
    scoped = join_dimension(token_events(lines), start, ["home"], ["path", "block"], "inner")
    inside = scoped.where(F.col("ts_nanos") >= F.col("period_start_nanos"))
    return _split(inside, "home", "period_start_nanos").drop("capped_events")


@query("cache_hit_rate")
def cache_hit_rate_by_home(spark, sf_dir):
    return cache_hit_rate(usage_volumes(_events(spark, sf_dir), ["home"]), ["home"])


@query("priced_volumes")
def priced_volumes(spark, sf_dir):
    volumes = usage_volumes(_events(spark, sf_dir), ["home"])
    return price_volumes(volumes, _prices(spark)).select(
        "home", "model", "tier_kind", "tier_text", "band", "issue_kind", "issue",
        F.round("cost", 6).alias("cost"),
    )


@query("priced_cost")
def priced_cost(spark, sf_dir):
    volumes = usage_volumes(_events(spark, sf_dir), ["home"])
    costs = strict_cost(price_volumes(volumes, _prices(spark)), ["home", "model"])
    return costs.withColumn("cost", F.round("cost", 4))


@query("price_issues")
def price_issues_by_home(spark, sf_dir):
    volumes = usage_volumes(_events(spark, sf_dir), ["home"])
    return price_issues(price_volumes(volumes, _prices(spark)), ["home"])


def _thread_inputs(spark, sf_dir):
    lines = event_lines(spark, sf_dir, variants=True)
    events = settle(token_events(lines).select(*EVENT_COLUMNS))
    files = settle(
        event_files(lines)
        .join(file_profile(events), ["home", "path"], "left")
        .withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint")))
    )
    return lines, events, files


@query("copy_collapse")
def copy_collapse(spark, sf_dir):
    _, events, files = _thread_inputs(spark, sf_dir)
    return mark_copies(files, events, ("home", "thread_id")).select("home", "thread_id", "path", "n_events", "is_copy")


@query("resume_chains")
def resume_chains(spark, sf_dir):
    _, events, files = _thread_inputs(spark, sf_dir)
    resolved = resolve_threads(files, events, ("home", "thread_id"))
    return resolved.groupBy("home", "thread_id").agg(
        F.count_if(~F.col("is_copy")).alias("timelines"), F.bool_and("is_sequential").alias("is_sequential")
    )


@query("fork_replay")
def fork_replay(spark, sf_dir):
    _, events, files = _thread_inputs(spark, sf_dir)
    children = files.where(F.col("parent_kind") == "parent").select("home", "path", "parent_id", "root_ts")
    judged, parents = parent_state(children, files, events)
    bounds = replay_bounds(judged.where("usable"), parents, events)
    return judged.join(bounds.withColumnRenamed("fork", "path"), ["home", "path"], "left").select(
        "home", "path", "usable", F.coalesce("replayed_events", F.lit(0)).cast("bigint").alias("replayed_events")
    )


def _tables(spark, sf_dir) -> UsageTables:
    # Nine branches read the lines and five the files; each would derive them again.
    lines = settle(event_lines(spark, sf_dir, variants=True))
    return usage_tables(lines, settle(event_files(lines)), now(), TZ, REFRESH_SECONDS)


@query("window_usage")
def window_usage(spark, sf_dir):
    report = window_report(_tables(spark, sf_dir), _prices(spark))
    return report.select(
        "home", "window_kind", "reliable", "deferred_files", "tokens", "overflow_tokens",
        F.round("credits_spent", 4).alias("credits_spent"), F.round("cost", 4).alias("cost"), "hit_tenths",
    )


@query("usage_report")
def usage_report_by_home(spark, sf_dir):
    report = usage_report(_tables(spark, sf_dir), _prices(spark), TZ)
    return report.select(
        "home", "today_reliable", "period_reliable", "today_tokens", "period_tokens", "period_token_estimate",
        F.round("period_value_estimate", 4).alias("period_value_estimate"), "today_text", "period_text",
        "period_label", "plan_label", "headline", "long_reset_text",
    )


@query("ancestor_closure")
def ancestor_closure_by_thread(spark, sf_dir):
    """Parent chains: each thread's parent is the one with half its number."""
    lines = event_lines(spark, sf_dir)
    edges = lines.select("home", "user_id").distinct().where("user_id > 0").select(
        F.lit(0).alias("home"), F.col("user_id").alias("thread"), F.expr("user_id div 2").alias("parent")
    )
    edges = settle(edges)
    return ancestor_closure(edges, edges).select("thread", "ancestor")


@query("history_compaction")
def history_compaction(spark, sf_dir):
    lines = event_lines(spark, sf_dir, variants=True)
    events = settle(carry_settings(lines).where("is_token"))
    files = settle(event_files(lines))
    start = F.expr(nanos_literal(SPLIT_DAY, "spark"))
    kept = compact_events(events, compactable_files(files).withColumn("start_nanos", start))
    return kept.groupBy("home", "path").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("line_no").alias("line_sum"), F.min("line_no").alias("first_line")
    )


def _observations(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    signed_in = F.when(F.col("line_no") % 3 != 0, F.concat(F.lit("account-"), "home"))
    return rate_limit_observations(lines).withColumn("account_id", signed_in)


@query("reset_events")
def reset_events_by_home(spark, sf_dir):
    found = reset_events(_observations(spark, sf_dir), REFRESH_SECONDS)
    return found.select("home", "ts_nanos", "line_no", "window", "resets_at", "remaining")


@query("early_restores")
def early_restores_by_home(spark, sf_dir):
    found = early_restores(_observations(spark, sf_dir), REFRESH_SECONDS)
    return found.select("home", "ts_nanos", "line_no", "window", "resets_at", "remaining")


@query("overflow_alerts")
def overflow_alerts_by_home(spark, sf_dir):
    readings = (
        event_lines(spark, sf_dir)
        .where(F.col("balance").isNotNull() & F.col("limits").isNotNull())
        .withColumn("period", F.col("limits.secondary.resets_at"))
    )
    found = overflow_alerts(readings, REFRESH_SECONDS)
    return found.withColumn("credits", F.round("credits", 4))


def _looks(spark, sf_dir):
    line = F.col("line_no")
    windows = {
        f"{side}_{name}": F.col(f"{side}.{field}") * (60 if name == "seconds" else 1)
        for side in ("primary", "secondary")
        for name, field in (("used", "used_percent"), ("seconds", "window_minutes"), ("resets_at", "resets_at"))
    }
    looks = rate_limit_observations(event_lines(spark, sf_dir)).select(
        "home",
        (F.col("ts_nanos") + (line % 4) * 60_000_000_000 + line).alias("observed_nanos"),
        F.col("ts_nanos").alias("received"),
        F.when(line % 3 != 0, F.concat(F.lit("account-"), F.expr("line_no div 40 % 2"))).alias("account"),
        F.when(line % 60 < 55, "usage").otherwise("other").alias("limit"),
        *[c.alias(n) for n, c in windows.items()],
        F.when(line % 5 != 4, (line % 4) * 0.125).alias("overflow_credits"),
    )
    return looks


@query("watch_alerts")
def watched_alerts(spark, sf_dir):
    """The full alert rules over looks that come late, of switching accounts and limits."""
    return find_alerts(_looks(spark, sf_dir), REFRESH_SECONDS)


@query("streamed_alerts")
def streamed_alerts(spark, sf_dir):
    """The same looks as a stream that stops and goes on half way."""
    looks = settle(_looks(spark, sf_dir))
    folder, split = scratch_folder(spark, "stream"), F.expr(nanos_literal(SPLIT_DAY, "spark"))
    incoming = spark.readStream.schema(looks.schema).parquet(f"{folder}/in/*")
    rules = AlertRules(REFRESH_SECONDS)
    for number, part in enumerate((F.col("observed_nanos") < split, F.col("observed_nanos") >= split)):
        looks.where(part).write.parquet(f"{folder}/in/{number}")
        watch(incoming, rules, folder).trigger(availableNow=True).start().awaitTermination()
    return alerts_of(spark, folder).select("home", "observed_nanos", "kind", "seconds", "value")


def _streamed_slices(spark, sf_dir):
    """Sums per account and second of the events as a stream in several batches."""
    events = _events(spark, sf_dir).select("home", "ts_nanos", "delta_total", "overflow")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = write_settled(events.repartition(parts, "ts_nanos"))
    folder = scratch_folder(spark, "stream")
    incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(2, parts // 2)).parquet(source)
    keep_slices(incoming, folder).trigger(availableNow=True).start().awaitTermination()
    return kept_slices(spark, folder)


@query("streamed_period_usage")
def streamed_period_usage(spark, sf_dir):
    """Boundaries that are known only after the events have streamed by."""
    slices = _streamed_slices(spark, sf_dir)
    start = period_boundary(_status(event_lines(spark, sf_dir))).select("home", "period_start_nanos")
    return cut_periods(slices, start).select("home", "period_start_nanos", *[F.col(n).cast("bigint").alias(n) for n in SUMS])


@query("streamed_today_usage")
def streamed_today_usage(spark, sf_dir):
    today = local_date(now(), TZ)
    inside = _streamed_slices(spark, sf_dir).where(local_date(F.col("second") * NANOS, TZ) == today)
    return inside.groupBy("home").agg(*[F.sum(n).cast("bigint").alias(n) for n in SUMS])


@query("manifest_diff")
def manifest_diff_by_file(spark, sf_dir):
    """Yesterday's manifest against today's listing, both taken from the logs."""
    lines = event_lines(spark, sf_dir)
    split = F.expr(nanos_literal(SPLIT_DAY, "spark"))
    user = F.col("user_id")

    def snapshot(rows):
        sums = rows.groupBy("home", "path", "user_id").agg(
            F.count(F.lit(1)).alias("length"), F.max("ts_nanos").alias("modified_at")
        )
        return sums.withColumn("identity", F.col("path")).withColumn("consumed", F.col("length"))

    stored = snapshot(lines.where(F.col("ts_nanos") < split)).where(user % 6 != 0)
    cut = (user % 4 != 1) | (F.col("ts_nanos") < split)
    listing = snapshot(lines.where(cut & ((user % 8 != 3) | (F.col("line_no") % 2 == 0)))).where(user % 9 != 0)
    # Some untouched files have moved to the archive, keeping their identity.
    moved = (user % 4 == 1) & (user % 10 == 1)
    listing = listing.withColumn("path", F.when(moved, F.concat(F.lit("archive/"), "path")).otherwise(F.col("path")))
    return manifest_diff(listing, stored)


@query("price_gap_lifecycle")
def price_gap_lifecycle(spark, sf_dir):
    """Gaps of the first half followed into the second, with a newer sheet."""
    split = F.expr(nanos_literal(SPLIT_DAY, "spark"))
    events = settle(_events(spark, sf_dir))
    newer = price_frame(spark, NEWER_PRICE_ROWS)

    def gaps(rows, prices):
        issues = price_issues(price_volumes(usage_volumes(rows, ["home"]), prices), ["home"])
        return issues.where("issue_kind = 'gap'")

    state = gaps(events.where(F.col("ts_nanos") < split), _prices(spark)).select(
        *GAP, (now() - F.expr("if(band = 'short', 7L, 1L) * 3600000000000")).alias("first_seen"),
        F.lit(False).alias("gave_up"),
    )
    current = gaps(events.where(F.col("ts_nanos") >= split), newer)
    return follow_gaps(state, current, newer, now()).select(*GAP, "event", "gave_up", "open")


@query("display_texts")
def display_texts(spark, sf_dir):
    """Every report text over the usage of each account and day."""
    events = event_lines(spark, sf_dir).where("is_token")
    days = events.groupBy("home", F.expr("ts_nanos div 86400000000000").alias("day")).agg(
        F.sum(F.coalesce("last.total", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("last.cached_input", F.lit(0))).alias("cached"),
        F.sum(F.coalesce("last.input", F.lit(0)) - F.coalesce("last.cached_input", F.lit(0))).alias("uncached"),
        F.max("ts_nanos").alias("latest"),
    )
    seconds = F.expr("latest div 1000000000 % 2000000")
    return days.select(
        "home", "day",
        display.compact_tokens(F.col("tokens"), "en").alias("en"),
        display.compact_tokens(F.col("tokens") * 1000, "zh").alias("zh"),
        hit_rate_tenths(F.col("cached"), F.col("uncached")).alias("hit"),
        display.compact_countdown(seconds).alias("countdown"),
        display.window_name(F.expr("(latest div 1000000000 % 700) * 3600")).alias("window_name"),
        display.elapsed_label(F.expr("latest div 1000000000"), F.expr(f"({AS_OF_SPARK}) div 1000000000")).alias("elapsed"),
    )


@query("log_line_fields")
def log_line_fields(spark, sf_dir):
    """Usage fields read back from JSON log text."""
    parsed = parse_text(settle(log_text(spark, sf_dir).drop("ts_nanos"))).where("is_marked")
    sides = [
        F.col(f"{side}.{name}").cast("bigint").alias(f"{side}_{name}")
        for side in ("total", "last") for name in ("input", "cached_input", "output", "total")
    ]
    return parsed.select(
        "home", "line_no", "is_broken", "ts_nanos", "kind", "model_set", "sets_tier", "tier_set_kind", "tier_set_text", "source",
        *sides, "primary_percent", F.round("balance", 6).alias("balance"), F.col("limits.primary.resets_at").alias("resets_at"),
    )


@query("rate_limit_responses")
def rate_limit_responses(spark, sf_dir):
    snapshots, _ = parse_rate_limits(response_rows(spark, sf_dir))
    return snapshots.select(
        "home", "account_id", "limit_id", "ts_nanos", F.col("primary.used_percent").alias("used_percent"),
        F.col("primary.resets_at").alias("resets_at"), F.col("secondary.window_minutes").alias("long_minutes"),
    )


@query("rate_limit_rejects")
def rate_limit_rejects(spark, sf_dir):
    _, rejects = parse_rate_limits(response_rows(spark, sf_dir))
    return rejects.groupBy("home", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("account_responses")
def account_responses(spark, sf_dir):
    return parse_accounts(account_rows(spark, sf_dir))


@query("merged_snapshots")
def merged_snapshots(spark, sf_dir):
    """Latest limits of two sources of looks, as one of each home."""
    merged = merge_snapshots(*split_snapshots(spark, sf_dir))
    return merged.select(
        "home", "ts_nanos", F.col("primary.resets_at").alias("resets_at"), F.col("secondary.resets_at").alias("long_resets_at"), "plan_type"
    )


@query("merged_messages")
def merged_messages(spark, sf_dir):
    """Alert texts of each account and day, those of one kind and window order as one."""
    looks = event_lines(spark, sf_dir).where("is_token").select(
        "home", F.expr("ts_nanos div 86400000000000 * 86400000000000").alias("ts_nanos"),
        F.when(F.col("line_no") % 2 == 0, "reset").otherwise("restored").alias("kind"),
        (F.col("line_no") % 3).cast("int").alias("rank"),
    )
    return merge_messages(looks.distinct().withColumn("body", F.concat("kind", F.lit(" "), F.col("rank").cast("string"))))


@query("money_texts")
def money_texts(spark, sf_dir):
    """Amounts of every order in cents as the report prints them."""
    cents = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey as bigint) as k", "cast(o_orderkey % 30011 as bigint) as cents")
    return cents.select(
        "k", display.usd((F.col("cents") - 100) / F.lit(100.0)).alias("usd"), display.credits_text(F.col("cents") / F.lit(100.0)).alias("credits")
    )


@query("price_sheet_rows")
def price_sheet_rows(spark, sf_dir):
    prices, _ = parse_price_sheets(sheet_rows(spark, sf_dir))
    return prices.select(
        "sheet_id", "model", "tier", "is_split", F.col("short.input").alias("short_input"),
        F.col("short.cached_input").alias("short_cached"), F.col("short.output").alias("short_output"),
        F.col("long.input").alias("long_input"), F.col("long.output").alias("long_output"),
    )


@query("price_sheet_faults")
def price_sheet_faults(spark, sf_dir):
    _, faults = parse_price_sheets(sheet_rows(spark, sf_dir))
    return faults


@query("run_diagnostics")
def run_diagnostics_by_home(spark, sf_dir):
    return run_diagnostics(_tables(spark, sf_dir))


@query("streamed_deltas")
def streamed_deltas(spark, sf_dir):
    """The incremental parser over the whole table as a stream, in segments."""
    lines = event_lines(spark, sf_dir)
    numbered = dense_positions(lines, ["home", "path"]).withColumn("event_line", F.col("line_no")).withColumn("line_no", F.col("idx"))
    place = settle(numbered.select("path", "line_no", "event_line"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = stream_lines(numbered).repartition(parts, "line_no")
    configure_streaming(spark)
    segments = write_settled(source)
    incoming = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", max(2, parts // 2)).parquet(segments)
    target = scratch_folder(spark, "stream")
    run = (
        process_lines(incoming).writeStream.format("parquet").option("checkpointLocation", f"{target}/state")
        .outputMode("append").trigger(availableNow=True).start(f"{target}/out")
    )
    run.awaitTermination()
    found = spark.read.schema(OUTPUT).parquet(f"{target}/out").join(place, ["path", "line_no"])
    return found.select(
        F.col("home").cast("bigint").alias("home"), "path", F.col("event_line").alias("line_no"), "is_duplicate", "is_stale",
        *[F.col(c).cast("bigint").alias(c) for c in DELTAS],
    )


def _second_run(spark, sf_dir) -> Refresh:
    """A tree of logs, scanned, changed in every way, and refreshed."""
    lines = settle(logged_lines(spark, sf_dir))
    root, state = scratch_folder(spark, "logs"), scratch_folder(spark, "store")
    for stage in (1, 2):
        write_stage(lines, root, stage)
        run = refresh(spark, root, TZ, state, buckets=16)
    return run


def _log_file() -> list[F.Column]:
    return [user_of(F.col("path")).alias("user_id"), period_of(F.col("path")).alias("period")]


@query("discovered_files")
def discovered_files(spark, sf_dir):
    """What the scan finds in homes with hidden, blank and percent names."""
    root = scratch_folder(spark, "logs")
    write_stage(settle(logged_lines(spark, sf_dir)), root, 1)
    files, _ = discover(spark, root)
    home = F.element_at(F.split("home", "/"), -1)
    return files.where("length > 0 AND readable").select(
        home.alias("home_name"), *_log_file(), "filename_thread_id", F.col("partition_date").cast("string").alias("partition_date")
    )


@query("resumed_lines")
def resumed_lines(spark, sf_dir):
    """Lines of a scan that resumed at the bytes that were new, in file order."""
    lines = _second_run(spark, sf_dir).logs.lines
    place = Window.partitionBy("path").orderBy("line_no")
    return lines.select(
        *_log_file(), F.row_number().over(place).cast("bigint").alias("n"), "ts_nanos", "kind", "model_set", "is_token",
        F.col("total.total").cast("bigint").alias("total_total"), F.col("last.output").cast("bigint").alias("last_output"),
    )


@query("refreshed_usage")
def refreshed_usage(spark, sf_dir):
    """Token events of the stored buckets after the second run, per file."""
    events = _second_run(spark, sf_dir).events
    return events.groupBy(*_log_file()).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.sum(c).cast("bigint").alias(c) for c in DELTAS],
        F.coalesce(F.sum(F.when(F.col("overflow"), F.col("delta_total"))), F.lit(0)).cast("bigint").alias("overflow_tokens"),
    )


@query("refresh_counts")
def refresh_counts(spark, sf_dir):
    """What the second run listed, read and added, per home."""
    run = _second_run(spark, sf_dir).run
    return run.select(
        F.element_at(F.split("home", "/"), -1).alias("home_name"), "files_listed", "files_read", "files_unchanged", "files_failed",
        "lines_read", "events_added", "parse_errors", "folders_failed",
    )


@query("dirty_threads")
def dirty_threads(spark, sf_dir):
    """Thread outcomes of the first half, brought up to date for the users of whom more has come."""
    lines = event_lines(spark, sf_dir, variants=True)
    early = F.col("ts_nanos") < F.expr(nanos_literal(SPLIT_DAY, "spark"))

    def inputs(rows):
        events = settle(token_events(rows).select(*EVENT_COLUMNS))
        files = event_files(rows).join(file_profile(events), ["home", "path"], "left")
        return settle(files.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint")))), events

    stored = settle(thread_outcomes(*inputs(lines.where(early))))
    files, events = inputs(lines.where(early | (F.col("user_id") % 3 == 0)))
    changed = files.where("user_id % 3 = 0")
    found, _ = refresh_outcomes(stored, files, events, changed)
    return found


@query("restored_history")
def restored_history(spark, sf_dir):
    """Stored events after all were trimmed to the second half, and those of every other home restored."""
    lines = event_lines(spark, sf_dir, variants=True)
    store = Buckets(spark, scratch_folder(spark, "store"), ("lines", "events", "files"), ("home", "path"), 16)
    store.write("lines", 0, lines)
    lines = store.written("lines", 0, lines)
    store.write("events", 0, token_events(lines).select(*EVENT_COLUMNS))
    store.write("files", 0, event_files(lines).withColumn("history_start_nanos", F.lit(None).cast("bigint")))
    entry = store.commit(None, 0, set(range(16)))
    start = F.expr(nanos_literal(SPLIT_DAY, "spark"))
    homes = settle(lines.select("home").distinct())
    entry = compact_history(store, entry, homes.withColumn("start_nanos", start))
    required = homes.withColumn("required_nanos", start - F.when(F.col("home") % 2 == 0, F.lit(NANOS)).otherwise(F.lit(0)))
    entry, _ = restore_history(store, entry, required)
    return store.read(entry, "events").groupBy("home", "path").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("line_no").alias("line_sum"), F.min("line_no").alias("first_line")
    )


@query("followed_deltas")
def followed_deltas(spark, sf_dir):
    """The lines of every file as a stream in order, parsed from the carried values of the batches before."""
    # A batch derives its own lines only, as the condition on their numbers reaches the scan.
    lines = event_lines(spark, sf_dir)
    folder = scratch_folder(spark, "stream")
    incoming = spark.readStream.schema(lines.schema).parquet(f"{folder}/in/*")
    columns = ["home", "path", "line_no", "is_duplicate", "is_stale", *DELTAS]
    cuts = [r["cut"] for r in lines.agg(F.percentile_approx("line_no", F.array(F.lit(0.3), F.lit(0.6)), 1000).alias("cuts")).select(F.explode("cuts").alias("cut")).collect()]
    for number, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 2**62], strict=True)):
        lines.where((F.col("line_no") > low) & (F.col("line_no") <= high)).write.parquet(f"{folder}/in/{number}")
        parse_lines(incoming, columns, folder).trigger(availableNow=True).start().awaitTermination()
    return events_of(spark, folder).select(*columns)
