"""History compaction: drop what no later report or parse can need.

Of the stretch of events before the first required day only the event just
before it and each source's peak snapshot stay; they are all the continuing
parser state depends on. Files other timelines refer to are left whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import USAGE_PROVIDER
from tallyspark.functions.counters import CounterMath
from tallyspark.operators.blocks import spread_over_blocks
from tallyspark.operators.carry import FILE


def required_start_nanos(today: Column, period_start_date: Column, tz: str) -> Column:
    """Local midnight of the first day any window still needs."""
    from tallyspark.operators.windows import local_midnight_nanos

    return local_midnight_nanos(F.least(today, period_start_date), tz)


def protected_files(files: DataFrame) -> DataFrame:
    """Files whose whole history others depend on: copies and resumed files of
    a thread, forks, and every file of a fork's parent."""
    crowded = (
        files.where(F.col("filename_thread_id").isNotNull())
        .groupBy("home", "filename_thread_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("home", "filename_thread_id")
    )
    forks = files.where(F.col("parent_kind") == "parent")
    parents = forks.select("home", F.col("parent_id").alias("filename_thread_id"))
    linked = crowded.unionByName(parents).distinct()
    return (
        files.join(linked, ["home", "filename_thread_id"], "left_semi")
        .select(*FILE)
        .unionByName(forks.select(*FILE))
        .distinct()
    )


def compactable_files(files: DataFrame) -> DataFrame:
    sound = ~(F.col("uncertain") | F.col("token_without_timestamp"))
    ours = F.col("has_root") & (F.col("provider") == USAGE_PROVIDER) & F.col("thread_id").isNotNull()
    return files.where(sound & ours & (F.col("parent_kind") == "none")).join(
        protected_files(files), list(FILE), "left_anti"
    )


def compact_events(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events that stay. ``files``: ``home, path, start_nanos`` of the files to
    compact; events of other files, and all events where ``start_nanos`` is
    NULL, stay. ``events`` is a table with ``total, source, model``."""
    math = CounterMath.of(events)
    scope = spread_over_blocks(files.select(*FILE, "start_nanos").where(F.col("start_nanos").isNotNull()), events)
    old = events.join(scope, [*FILE, "block"])
    # Only a leading stretch goes; old events further down keep their place.
    needed = F.col("ts_nanos").isNull() | (F.col("ts_nanos") >= F.col("start_nanos"))
    cuts = old.groupBy(*FILE).agg(F.min(F.when(needed, F.col("line_no"))).alias("_cut"))
    cuts = spread_over_blocks(cuts, events)
    slim = events.select(
        *FILE, "block", "line_no", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
        "model", math.effective(F.col("total")).alias("_teff"),
    )
    before = slim.join(cuts, [*FILE, "block"]).where(F.col("_cut").isNull() | (F.col("line_no") < F.col("_cut")))
    last = before.groupBy(*FILE).agg(F.max("line_no").alias("line_no"))
    # A source's peak counts from the last change of its model on.
    source = [*FILE, "_source"]
    totals = before.where(F.col("_teff").isNotNull())
    final = totals.groupBy(*source).agg(F.max_by(F.struct("model"), "line_no").alias("_final"))
    blocks = totals.select(*source, "block").distinct()
    tagged = totals.join(blocks.join(final, source), [*source, "block"])
    other = ~F.col("model").eqNullSafe(F.col("_final.model"))
    since = tagged.groupBy(*source).agg(F.coalesce(F.max(F.when(other, F.col("line_no"))), F.lit(-1)).alias("_since"))
    peaks = (
        totals.join(blocks.join(since, source), [*source, "block"])
        .where(F.col("line_no") > F.col("_since"))
        .groupBy(*source)
        .agg(F.max(F.struct("_teff", (-F.col("line_no")).alias("_neg"))).alias("_p"))
        .select(*FILE, (-F.col("_p._neg")).alias("line_no"))
    )
    keep = last.unionByName(peaks).distinct()
    dropped = before.select(*FILE, "block", "line_no").join(keep, [*FILE, "line_no"], "left_anti")
    return events.join(dropped, [*FILE, "block", "line_no"], "left_anti")


def compact_balances(balances: DataFrame, files: DataFrame) -> DataFrame:
    """Readings before the start never form a pair inside a window."""
    scope = spread_over_blocks(files.select(*FILE, "start_nanos"), balances)
    return (
        balances.join(scope, [*FILE, "block"], "left")
        .where(F.col("start_nanos").isNull() | (F.col("ts_nanos") >= F.col("start_nanos")))
        .drop("start_nanos")
    )


def needs_history(files: DataFrame, required: Column) -> DataFrame:
    """Compacted files that a wider window, a new fork or a new copy needs in
    full again: to be read once more from the logs."""
    wider = required.isNull() | (required < F.col("history_start_nanos"))
    compacted = files.where(F.col("history_start_nanos").isNotNull())
    linked = compacted.join(protected_files(files), list(FILE), "left_semi").select(*FILE)
    return compacted.where(wider).select(*FILE).unionByName(linked).distinct()
