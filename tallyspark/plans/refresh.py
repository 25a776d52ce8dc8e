"""Incremental refresh: read what was appended, rewrite the buckets it falls in.

The store keeps parsed lines, token events, file rows and the manifest in hash
buckets of (home, path). A run classifies the listing against the manifest,
reads the bytes that are new and writes the buckets that hold a changed file as
a new generation; other buckets stay as they are. A small log entry names the
live generation of every bucket, so readers of an older entry keep their files
until these have aged. What a run reads and writes follows what has changed.

Appended files resume at their first byte that was not read, if the bytes
before it are still the same (a digest in the manifest says so); otherwise the
file was rewritten and is read again. Lines are numbered by bytes, so the
stored tables equal those of a cold scan.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.carry import FILE
from tallyspark.operators.timeline import token_events
from tallyspark.plans.usage_report import EVENT_COLUMNS
from tallyspark.session import settle
from tallyspark.sources.buckets import KEEP_SECONDS, Buckets, Entry
from tallyspark.sources.byte_log import SPLIT_BYTES, canonical, discover, probe_tails
from tallyspark.sources.log_scan import lines_of_index, logs_of, ranges_of_index, read_index
from tallyspark.sources.manifest import manifest_diff
from tallyspark.sources.session_logs import SessionLogs, file_table
from tallyspark.sources.tables import TABLE_VERSION

BUCKETS = 256
TABLES = ("lines", "events", "files", "manifest")


def log_store(spark: SparkSession, state: str, root: str, tz: str, buckets: int = BUCKETS) -> Buckets:
    """The tables of one log root and time zone, under this version's rules."""
    named = hashlib.sha256(f"{canonical(root)}\n{tz}".encode()).hexdigest()[:16]
    return Buckets(spark, f"{state}/v{TABLE_VERSION}-{named}", TABLES, FILE, buckets)


@dataclass
class Refresh:
    """Outcome of one run. ``logs``: as of a cold scan; ``events``: its token
    events; ``run``: per home, files listed, read and failed, lines and bytes
    read, events added, folders not listed."""

    logs: SessionLogs
    events: DataFrame
    changes: DataFrame
    run: DataFrame
    changed_buckets: set[int] = field(default_factory=set)


def manifest_of(listed: DataFrame) -> DataFrame:
    """Listing to manifest; the thread id stands in for the creation of a file where the store keeps none."""
    identity = F.coalesce("filename_thread_id", "path").alias("identity")
    return listed.select(*FILE, identity, "length", F.col("length").alias("consumed"), "modified_at")


def classify(listed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``manifest_diff``, with files whose stored end has changed as ``rewritten``."""
    now = manifest_of(listed)
    if stored is None:
        return manifest_diff(now, now.limit(0))
    changes = settle(manifest_diff(now, stored))
    ends = stored.select("home", F.col("path").alias("_from"), "consumed", "tail")
    resumed = changes.where(F.col("change").isin("appended", "renamed")).withColumn("_from", F.coalesce("moved_from", "path"))
    probed = probe_tails(resumed.join(ends, ["home", "_from"]))
    judged = changes.join(probed, "path", "left")
    lost = F.col("change").isin("appended", "renamed") & ~F.coalesce("same_tail", F.lit(False))
    return judged.select(
        *FILE,
        F.when(lost, "rewritten").otherwise(F.col("change")).alias("change"),
        F.when(~lost, F.col("moved_from")).alias("moved_from"),
        F.when(lost, F.lit(0)).otherwise(F.col("resume_at")).cast("bigint").alias("resume_at"),
    )


def refresh(
    spark: SparkSession, root: str, tz: str, state: str, homes: list[str] | None = None, buckets: int = BUCKETS,
    split_bytes: int = SPLIT_BYTES, keep_seconds: float = KEEP_SECONDS,
) -> Refresh:
    """One run: continue from the stored state and store the new one."""
    store = log_store(spark, state, root, tz, buckets)
    before = store.newest()
    files, errors = discover(spark, root, homes)
    listed = settle(files)
    stored = store.read(before, "manifest")
    changes = settle(classify(listed, stored))
    touched = changes.where("change <> 'unchanged'")
    place = touched.select("home", "path").union(touched.where("moved_from IS NOT NULL").select("home", F.col("moved_from").alias("path")))
    changed = store.numbers_of(place)

    wanted = changes.where(F.col("change").isin("new", "rewritten", "appended")).select("path", F.col("resume_at").alias("from_byte"))
    index = read_index(wanted.join(listed.select("path", F.col("length").alias("to_byte")), "path"), split_bytes)
    fresh, read = lines_of_index(index), settle(ranges_of_index(index))

    generation = 0 if before is None else before.number + 1
    if changed or before is None:
        _write(store, before, generation, changed, listed, changes, fresh, read, tz)
        after = store.commit(before, generation, changed)
        store.forget(keep_seconds)
    else:
        after = before
    return Refresh(_logs(store, after, errors, fresh, listed, tz), _events(store, after, fresh), changes, _run(listed, changes, fresh, read, errors), changed)


def _write(store: Buckets, before, generation, changed, listed, changes, fresh, read, tz) -> None:
    """The changed buckets of every table."""
    inside = store.bucket().isin(sorted(changed)) if changed else F.lit(False)
    kept = changes.where(F.col("change").isin("unchanged", "appended", "renamed")).select(
        "home", F.coalesce("moved_from", "path").alias("path"), F.col("path").alias("_path")
    )
    lines = fresh
    old = store.read(before, "lines", changed)
    if old is not None:
        old = old.join(kept, list(FILE)).withColumn("path", F.col("_path")).drop("_path")
        lines = fresh.unionByName(old)
    # A moved file's lines leave their bucket for that of the new path; both are among the changed.
    store.write("lines", generation, lines)
    written = store.written("lines", generation, lines)
    here = listed.where(inside)
    status = here.join(read, "path", "left")
    tails = store.read(before, "manifest", changed)
    if tails is not None:
        moved = tails.select("home", "path", F.col("tail").alias("_tail"), F.col("failed").alias("_failed")).join(kept, list(FILE))
        status = status.join(moved.select("home", F.col("_path").alias("path"), "_tail", "_failed"), list(FILE), "left")
    else:
        status = status.withColumns({"_tail": F.lit(None).cast("string"), "_failed": F.lit(None).cast("boolean")})
    status = status.withColumn("failed", F.coalesce("failed", "_failed", F.lit(False))).withColumn("tail", F.coalesce("tail", "_tail"))
    store.write("events", generation, token_events(written.where("is_marked AND NOT is_broken")).select(*EVENT_COLUMNS))
    judged = here.join(status.select(*FILE, F.col("failed").alias("unread")), list(FILE), "left")
    store.write("files", generation, file_table(written, judged, tz))
    # A file that could not be read has no end to go on from: the next run reads it again.
    manifest = manifest_of(here).join(status.select(*FILE, "tail", "failed"), list(FILE)).where("NOT failed")
    store.write("manifest", generation, manifest)


def _logs(store: Buckets, entry: Entry, errors: DataFrame, fresh: DataFrame, listed: DataFrame, tz: str) -> SessionLogs:
    lines, files = store.read(entry, "lines"), store.read(entry, "files")
    if lines is None:
        lines = fresh
    if files is None:
        return logs_of(lines, listed.withColumn("unread", F.lit(False)), tz, errors)
    return SessionLogs(lines.where("is_marked AND NOT is_broken"), files, errors)


def _events(store: Buckets, entry: Entry, fresh: DataFrame) -> DataFrame:
    events = store.read(entry, "events")
    return token_events(fresh).select(*EVENT_COLUMNS).limit(0) if events is None else events


def _run(listed: DataFrame, changes: DataFrame, fresh: DataFrame, read: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts of one run, per home."""
    zero = F.lit(0).cast("bigint")
    counted = listed.join(read, "path", "left").join(changes.select("path", "change"), "path", "left")
    per_home = counted.groupBy("home").agg(
        F.count(F.lit(1)).alias("files_listed"),
        F.count("lines_read").alias("files_read"),
        F.count_if(F.col("change") == "unchanged").alias("files_unchanged"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("files_failed"),
        F.coalesce(F.sum("lines_read"), zero).alias("lines_read"),
        F.coalesce(F.sum("bytes_read"), zero).alias("bytes_read"),
    )
    added = fresh.groupBy("home").agg(
        F.count_if(F.col("is_token") & ~F.col("is_broken")).alias("events_added"), F.count_if(F.col("is_broken") | ~F.col("is_utf8")).alias("parse_errors")
    )
    lost = errors.select("home", F.col("errors").alias("folders_failed"))
    return per_home.join(added, "home", "left").join(lost, "home", "full_outer").na.fill(0)
