"""Stored history: trimmed where nothing needs it, restored where something does.

The store's parsed lines are never trimmed; its token events are. Compaction
rewrites the events of files whose leading stretch no report needs, restoring
builds them again from the lines of just these files. Thread outcomes (copies,
order, fork replay) are kept per file and computed again only for threads that
a change can bear on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.blocks import spread_over_blocks
from tallyspark.operators.carry import FILE, carry_settings
from tallyspark.operators.compaction import compact_events, compactable_files, needs_history
from tallyspark.operators.forks import parent_state, replay_bounds
from tallyspark.operators.threads import resolve_threads
from tallyspark.operators.timeline import token_events
from tallyspark.plans.usage_report import EVENT_COLUMNS
from tallyspark.session import settle
from tallyspark.sources.buckets import Buckets, Entry

THREAD = ("home", "thread_id")


def usable_lines(lines: DataFrame) -> DataFrame:
    """Without the broken lines that a store keeps for the files' health."""
    return lines.where("is_marked AND NOT is_broken") if "is_broken" in lines.columns else lines


def compact_history(store: Buckets, entry: Entry, starts: DataFrame) -> Entry:
    """Trim the events before ``starts`` (``home, start_nanos``) of all files that may be trimmed.

    Reads the file table and the buckets with such files, and writes only the
    events and file rows of these.
    """
    files = store.read(entry, "files")
    if files is None:
        return entry
    earlier = F.col("history_start_nanos").isNull() | (F.col("history_start_nanos") < F.col("start_nanos"))
    target = compactable_files(files).join(starts, "home").where(F.col("start_nanos").isNotNull() & earlier)
    target = settle(target.select(*FILE, "start_nanos"))
    changed = store.numbers_of(target)
    if not changed:
        return entry
    lines, events = store.read(entry, "lines", changed), store.read(entry, "events", changed)
    kept = settle(carry_settings(usable_lines(lines)).where("is_token"))
    kept = compact_events(kept, target).select(*FILE, "line_no")
    files = store.read(entry, "files", changed).join(target, list(FILE), "left")
    files = files.withColumn("history_start_nanos", F.coalesce("start_nanos", "history_start_nanos")).drop("start_nanos")
    return _replace(store, entry, changed, events.join(kept, [*FILE, "line_no"], "left_semi"), files)


def restore_history(store: Buckets, entry: Entry, required: DataFrame) -> tuple[Entry, DataFrame]:
    """Build the events anew of trimmed files that are needed in full: by an earlier start
    (``home, required_nanos``; null: all), or because a fork or copy has come up. Returns the files too."""
    files = store.read(entry, "files")
    needed = files.join(required, "home", "left") if files is not None else None
    if needed is None:
        return entry, required.select("home", F.lit("").alias("path")).limit(0)
    needed = settle(needs_history(needed, F.col("required_nanos")))
    changed = store.numbers_of(needed)
    if not changed:
        return entry, needed
    lines, events = store.read(entry, "lines", changed), store.read(entry, "events", changed)
    whole = token_events(usable_lines(lines).join(needed, list(FILE), "left_semi")).select(*EVENT_COLUMNS)
    events = events.select(*EVENT_COLUMNS).join(needed, list(FILE), "left_anti").unionByName(whole)
    files = store.read(entry, "files", changed).join(needed.withColumn("_whole", F.lit(True)), list(FILE), "left")
    files = files.withColumn("history_start_nanos", F.when(F.col("_whole").isNull(), F.col("history_start_nanos"))).drop("_whole")
    return _replace(store, entry, changed, events, files), needed


def _replace(store: Buckets, entry: Entry, changed: set[int], events: DataFrame, files: DataFrame) -> Entry:
    generation = entry.number + 1
    store.write("events", generation, events)
    store.write("files", generation, files.withColumn("compacted", F.col("history_start_nanos").isNotNull()))
    return store.commit(entry, generation, {"events": changed, "files": changed})


def thread_outcomes(files: DataFrame, events: DataFrame) -> DataFrame:
    """``home, path, thread_id, is_copy, is_sequential, replay_ok, replayed_events`` of every file with a thread.

    ``files``: with ``n_events, first_ts, max_ts``.
    """
    threaded = files.where(F.col("thread_id").isNotNull())
    resolved = resolve_threads(threaded, events, THREAD).select(*FILE, "thread_id", "parent_kind", "is_copy", "is_sequential")
    children = threaded.where(F.col("parent_kind") == "parent").select(*FILE, "parent_id", "root_ts")
    judged, parents = parent_state(children, files, events)
    judged = settle(judged)
    bounds = replay_bounds(judged.where("usable"), parents, events)
    replay = judged.join(bounds.withColumnRenamed("fork", "path"), list(FILE), "left").select(*FILE, "usable", "replayed_events")
    joined = resolved.join(replay, list(FILE), "left")
    usable = F.when(F.col("parent_kind") == "none", F.lit(True)).otherwise(F.coalesce("usable", F.lit(False)))
    return joined.select(
        *FILE, "thread_id", "is_copy", "is_sequential", usable.alias("replay_ok"), F.coalesce("replayed_events", F.lit(0).cast("bigint")).alias("replayed_events")
    )


def affected_threads(files: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """``home, thread_id`` of threads that changed files (``home, path``) bear on.

    The threads they are or were in, and the forks of these: a fork is matched
    with its parent's own events, so it goes no further down.
    """
    seeds = files.select(*FILE, "thread_id").unionByName(files.select(*FILE, F.col("filename_thread_id").alias("thread_id")))
    seeds = seeds.unionByName(stored.select(*FILE, "thread_id")).where(F.col("thread_id").isNotNull())
    seeds = seeds.join(changed.select(*FILE), list(FILE), "left_semi").select(*THREAD).distinct()
    forks = files.where(F.col("parent_kind") == "parent").select("home", "thread_id", "parent_id")
    forks = forks.join(seeds.withColumnRenamed("thread_id", "parent_id"), ["home", "parent_id"], "left_semi")
    return settle(seeds.unionByName(forks.select(*THREAD).where(F.col("thread_id").isNotNull())).distinct())


def refresh_outcomes(stored: DataFrame, files: DataFrame, events: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``thread_outcomes`` after some files changed, appeared or went, and the files that were looked at.

    Only affected threads are computed, from their own events and those of
    their forks' parents; the outcomes of all others are kept.
    """
    affected = affected_threads(files, stored, changed)
    own = files.join(affected, list(THREAD), "left_semi")
    wanted = own.where(F.col("parent_kind") == "parent").select("home", F.col("parent_id").alias("filename_thread_id")).distinct()
    parents = files.join(wanted, ["home", "filename_thread_id"], "left_semi")
    looked = settle(own.unionByName(parents).dropDuplicates(list(FILE)))
    history = settle(events.join(spread_over_blocks(looked.select(*FILE), events), [*FILE, "block"], "left_semi"))
    fresh = thread_outcomes(looked, history).join(affected, list(THREAD), "left_semi")
    kept = stored.join(affected, list(THREAD), "left_anti").join(files.select(*FILE), list(FILE), "left_semi")
    return kept.unionByName(fresh), looked
