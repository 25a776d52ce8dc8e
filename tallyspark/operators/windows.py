"""Reporting windows: which files count, what they add up to, and whether the
sum can be trusted."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import USAGE_PROVIDER
from tallyspark.functions.counters import CounterMath
from tallyspark.operators.blocks import spread_over_blocks
from tallyspark.operators.carry import FILE
from tallyspark.operators.credits import credits_debits
from tallyspark.operators.threads import resolve_threads
from tallyspark.operators.usage import BUCKET, MEASURES
from tallyspark.session import settle

WINDOWS = ("today", "period")


def local_time(nanos: Column, tz: str) -> Column:
    """Wall-clock timestamp in ``tz``; microseconds are exact, the rest is cut."""
    micros = F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))
    return F.from_utc_timestamp(F.timestamp_micros(micros), tz)


def local_date(nanos: Column, tz: str) -> Column:
    return F.to_date(local_time(nanos, tz))


def local_midnight_nanos(day: Column, tz: str) -> Column:
    """Epoch nanoseconds of local midnight; NULL when that midnight does not
    exist in ``tz`` (a clock change), where callers keep full history."""
    at = F.to_utc_timestamp(day.cast("timestamp"), tz)
    nanos = F.unix_micros(at) * F.lit(1000)
    return F.when(local_time(nanos, tz) == day.cast("timestamp"), nanos)


def file_buckets(events: DataFrame, files: DataFrame, today: Column, tz: str) -> DataFrame:
    """One pass over the events: per file and bucket, both windows side by side.

    ``files`` brings ``period_start_nanos``, ``period_start_date`` and
    ``replay_line_no`` (last replayed line of a fork, NULL otherwise). Use
    flags look at all events; sums leave the replayed ones out. Everything
    after this works on these rows, which are few per file.
    """
    math = CounterMath.of(events, "delta_total")
    scope = files.select(*FILE, "period_start_nanos", "period_start_date", "replay_line_no")
    ev = events.join(spread_over_blocks(scope, events), [*FILE, "block"])
    day = local_date(F.col("ts_nanos"), tz)
    inside = {
        "today": F.coalesce(day == today, F.lit(False)),
        "period": F.coalesce(F.col("ts_nanos") >= F.col("period_start_nanos"), F.lit(False)),
    }
    used = F.col("delta_total") != 0
    own = F.col("replay_line_no").isNull() | (F.col("line_no") > F.col("replay_line_no"))
    ev = ev.select(
        *FILE,
        *BUCKET,
        "overflow",
        "details_missing",
        "delta_total",
        *MEASURES.values(),
        F.coalesce(day == F.col("period_start_date"), F.lit(False)).alias("_on_start"),
        *[(inside[w] & used).alias(f"_use_{w}") for w in WINDOWS],
        *[(inside[w] & used & own).alias(f"_own_{w}") for w in WINDOWS],
    )
    sums = []
    for w in WINDOWS:
        mine = F.col(f"_own_{w}")
        sums.append(F.bool_or(f"_use_{w}").alias(f"use_{w}"))
        sums.append(F.bool_or(mine).alias(f"own_{w}"))
        sums.append(F.bool_or(mine & F.col("details_missing")).alias(f"details_missing_{w}"))
        for name, column in {"tokens": "delta_total", **MEASURES}.items():
            part = math.sum(F.when(mine, F.col(column)))
            sums.append(math.or_zero(part).alias(f"{name}_{w}"))
    return ev.groupBy(*FILE, *BUCKET, "overflow").agg(F.bool_or("_on_start").alias("on_start"), *sums)


def select_files(
    files: DataFrame, buckets: DataFrame, today: Column, discovery_complete: bool = True
) -> DataFrame:
    """Add use flags and ``selected_today`` / ``selected_period``.

    A file matters to a window when it has usage there, lies in a matching
    date folder, or was written late enough to hold such usage; the day before
    is kept because event times may run ahead of the file time.
    """
    use = buckets.groupBy(*FILE).agg(
        *[F.bool_or(f"use_{w}").alias(f"use_{w}") for w in WINDOWS], F.bool_or("on_start").alias("on_start")
    )
    df = files.join(use, list(FILE), "left")
    for flag in ("use_today", "use_period", "on_start"):
        df = df.withColumn(flag, F.coalesce(flag, F.lit(False)))
    start = F.col("period_start_date")
    picked = {
        "today": F.col("use_today")
        | F.coalesce(F.col("partition_date") == today, F.lit(False))
        | F.coalesce(F.col("modified_date") >= F.date_sub(today, 1), F.lit(False)),
        "period": F.col("period_start_nanos").isNotNull()
        & (
            F.col("use_period")
            | F.coalesce(F.col("partition_date").between(start, today), F.lit(False))
            | F.coalesce(F.col("modified_date") >= start, F.lit(False))
        ),
    }
    return df.select("*", *[picked[w].alias(f"selected_{w}") for w in WINDOWS])


def judge_files(selected: DataFrame) -> DataFrame:
    """One row per selected file and window with the verdict on the file.

    The order of the rules matters. ``counted`` files go on to their threads,
    ``ignored`` ones are none of this report's business, every other verdict
    makes the window unreliable.
    """
    entries = [
        F.struct(
            F.lit(w).alias("window_kind"),
            F.col(f"selected_{w}").alias("take"),
            F.col(f"use_{w}").alias("has_use"),
        )
        for w in WINDOWS
    ]
    rows = selected.withColumn(
        "_w", F.explode(F.filter(F.array(*entries), lambda e: e.getField("take")))
    ).select(
        *[c for c in selected.columns if not c.startswith(("use_", "selected_"))],
        F.col("_w.window_kind").alias("window_kind"),
        F.col("_w.has_use").alias("has_use"),
    )
    use, provider = F.col("has_use"), F.col("provider")
    verdict = (
        F.when(F.col("unread"), "unread")
        .when(~F.col("has_root") & (use | F.col("uncertain")), "no_root")
        .when(~F.col("has_root"), "ignored")
        .when(provider.isNull() & use, "no_provider")
        .when(provider.isNull() | (provider != USAGE_PROVIDER), "ignored")
        .when(F.col("uncertain") | F.col("token_without_timestamp"), "unsound")
        .when(F.col("thread_id").isNull() & use, "no_thread")
        .when(F.col("thread_id").isNull(), "ignored")
        .otherwise("counted")
    )
    return rows.withColumn("verdict", verdict)


def settle_threads(judged: DataFrame, events: DataFrame) -> DataFrame:
    """Counted files with their thread's outcome in ``role``.

    ``tallied``; ``copy``; ``overlap`` (the thread's files run side by side);
    ``no_parent`` (a fork whose parent history cannot be relied on).
    """
    thread = ("home", "window_kind", "thread_id")
    counted = settle(judged.where(F.col("verdict") == "counted"))
    resolved = resolve_threads(counted, events, thread)
    return resolved.withColumn(
        "role",
        F.when(F.col("is_copy"), "copy")
        .when(~F.col("is_sequential"), "overlap")
        .when(~F.col("replay_ok"), "no_parent")
        .otherwise("tallied"),
    )


def window_reliability(judged: DataFrame, roles: DataFrame, homes: DataFrame) -> DataFrame:
    """Per account and window: ``reliable``, ``deferred_files``, ``anchored``.

    A thread whose files overlap is deferred once; forks without usable
    parents one by one; both only if they have usage in the window. ``homes``:
    ``home, period_start_nanos`` and ``discovery_errors``, the number of its
    folders that could not be listed: an account with one is not reliable. The period
    needs an anchor: some counted provider's file touching its first day, or
    no file at all.
    """
    key = ["home", "window_kind"]
    bad = ~F.col("verdict").isin("counted", "ignored")
    anchor = (F.col("provider") == USAGE_PROVIDER) & F.col("has_root") & (
        (F.col("root_date") == F.col("period_start_date")) | F.col("on_start")
    )
    by_file = judged.groupBy(*key).agg(
        F.count_if(bad).alias("_bad"),
        F.count(F.lit(1)).alias("_selected"),
        F.coalesce(F.bool_or(anchor), F.lit(False)).alias("_anchor"),
    )
    by_thread = roles.groupBy(*key, "thread_id").agg(
        F.bool_or(F.coalesce(~F.col("is_sequential"), F.lit(False))).alias("_overlap"),
        F.bool_or("has_use").alias("_use"),
        F.count_if((F.col("role") == "no_parent") & F.col("has_use")).alias("_orphans"),
    )
    deferred = by_thread.groupBy(*key).agg(
        F.sum((F.col("_overlap") & F.col("_use")).cast("bigint") + F.col("_orphans")).alias("_deferred")
    )
    grid = homes.select("home", "period_start_nanos", "discovery_errors").withColumn(
        "window_kind", F.explode(F.array(*[F.lit(w) for w in WINDOWS]))
    )
    df = grid.join(by_file, key, "left").join(deferred, key, "left")
    zero = F.lit(0).cast("bigint")
    df = df.select(
        "home",
        "window_kind",
        "period_start_nanos",
        "discovery_errors",
        (F.coalesce("_bad", zero) + F.coalesce("_deferred", zero)).alias("deferred_files"),
        ((F.coalesce("_selected", zero) == 0) | F.coalesce("_anchor", F.lit(False))).alias("anchored"),
    )
    sound = (F.col("deferred_files") == 0) & (F.coalesce("discovery_errors", zero) == 0)
    in_period = F.col("anchored") & F.col("period_start_nanos").isNotNull()
    return df.withColumn(
        "reliable", sound & (in_period | (F.col("window_kind") == "today"))
    ).drop("period_start_nanos", "discovery_errors")


def tallied_buckets(buckets: DataFrame, roles: DataFrame) -> DataFrame:
    """Bucket rows of the files that count, one row per window."""
    tallied = roles.where(F.col("role") == "tallied").select(*FILE, "window_kind")
    entries = [
        F.struct(
            F.lit(w).alias("window_kind"),
            F.col(f"own_{w}").alias("own"),
            F.col(f"details_missing_{w}").alias("details_missing"),
            *[F.col(f"{name}_{w}").alias(name) for name in ("tokens", *MEASURES)],
        )
        for w in WINDOWS
    ]
    rows = buckets.withColumn("_w", F.explode(F.filter(F.array(*entries), lambda e: e.getField("own"))))
    rows = rows.select(*FILE, *BUCKET, "overflow", "_w.*").drop("own")
    return rows.join(tallied, [*FILE, "window_kind"])


def window_totals(tallied: DataFrame) -> DataFrame:
    """Tokens in the plan and beyond it, per account and window."""
    math = CounterMath.of(tallied, "tokens")

    def total(flag: Column) -> Column:
        return math.or_zero(math.sum(F.when(flag, F.col("tokens"))))

    return tallied.groupBy("home", "window_kind").agg(
        total(~F.col("overflow")).alias("tokens"), total(F.col("overflow")).alias("overflow_tokens")
    )


def window_volumes(tallied: DataFrame) -> DataFrame:
    math = CounterMath.of(tallied, "tokens")
    return (
        tallied.where(~F.col("overflow"))
        .groupBy("home", "window_kind", *BUCKET)
        .agg(
            *[math.sum(F.col(name)).alias(name) for name in MEASURES],
            F.bool_or("details_missing").alias("details_missing"),
        )
    )


def window_credits(
    balances: DataFrame, files: DataFrame, roles: DataFrame, today: Column, tz: str
) -> DataFrame:
    """Credits spent per account and window over the files that count there.

    A window is one stretch of time, so dropping readings outside it first
    leaves the neighbours inside it unchanged.
    """
    starts = files.select(*FILE, "period_start_nanos")
    tallied = roles.where(F.col("role") == "tallied").select(*FILE, "window_kind").join(starts, list(FILE))
    rows = balances.join(spread_over_blocks(tallied, balances), [*FILE, "block"])
    inside = F.when(
        F.col("window_kind") == "today", local_date(F.col("ts_nanos"), tz) == today
    ).otherwise(F.col("ts_nanos") >= F.col("period_start_nanos"))
    spent = credits_debits(
        rows.where(inside).withColumn("in_window", F.lit(True)), ("home", "window_kind")
    )
    return spent.withColumnRenamed("spent_in_window", "credits_spent")
