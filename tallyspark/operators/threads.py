"""Files of one session thread: archive copies and resumed sessions.

``files`` has one row per file: ``thread keys, home, path, n_events,
first_ts, max_ts``. A file is a copy when its (time, snapshot)
sequence is a prefix of another file of the thread. Prefixes are compared by
a digest that grows with the position, so finding copies is a semi join on
(thread, length, digest): linear in the events, no pairs of files, and a
group of any number of copies collapses map-side.

``files`` and ``events`` are expected to be tables (see ``session.settle``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.blocks import (
    added,
    carry_into_blocks,
    dense_positions,
    fold_neighbours,
    join_dimension,
    spread_over_blocks,
    upto,
    within_block,
)
from tallyspark.operators.carry import FILE
from tallyspark.session import settle

DIGEST_SEEDS = (11, 12)
DIGEST_BITS = 21  # three slices per 64-bit hash; sums stay exact up to 2^42 events
DIGEST = tuple(f"d{seed}_{part}" for seed in DIGEST_SEEDS for part in range(3))


def file_profile(events: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Per file: event count, first and latest event time."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min_by("ts_nanos", "line_no").alias("first_ts"),
        F.max("ts_nanos").alias("max_ts"),
    )


def _slices() -> list[Column]:
    """The hash of (position, time, snapshot), cut into 21-bit parts."""
    mask = F.lit((1 << DIGEST_BITS) - 1).cast("bigint")
    parts = []
    for seed in DIGEST_SEEDS:
        hashed = F.xxhash64(F.lit(seed), "idx", F.coalesce("ts_nanos", F.lit(-1)), "sig")
        for part in range(3):
            cut = F.shiftrightunsigned(hashed, part * DIGEST_BITS).bitwiseAND(mask)
            parts.append(cut.alias(f"d{seed}_{part}"))
    return parts


def prefix_digests(events: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Add ``idx`` and, per event, the digest of the file up to that event."""
    placed = dense_positions(events, keys)
    hashed = placed.select(*[c for c in placed.columns if c not in DIGEST], *_slices())
    ends = hashed.groupBy(*keys, "block").agg(*[F.sum(d).alias(f"_{d}") for d in DIGEST])
    carried = carry_into_blocks(ends, keys, {f"_in_{d}": added(f"_{d}") for d in DIGEST})
    spec = upto(within_block(keys))
    local = hashed.select(
        *[c for c in hashed.columns if c not in DIGEST],
        *[F.sum(d).over(spec).alias(f"_run_{d}") for d in DIGEST],
    )
    joined = local.join(carried, [*keys, "block"], "left")
    return joined.select(
        *[c for c in placed.columns if c not in DIGEST],
        F.struct(*[(F.col(f"_run_{d}") + F.coalesce(f"_in_{d}", F.lit(0))).alias(d) for d in DIGEST]).alias("digest"),
    )


def mark_copies(files: DataFrame, events: DataFrame, thread: Sequence[str]) -> DataFrame:
    """Add ``is_copy`` and ``is_crowded`` (thread of several files) to ``files``.

    Of equal files the smallest path stays; a file whose events begin a longer
    file goes. Only threads with more than one file look at events at all.
    """
    crowded = files.groupBy(*thread).agg(F.count(F.lit(1)).alias("_n"), F.max("n_events").alias("_max"))
    several = join_dimension(files, crowded.where("_n > 1"), thread, ["path"], "inner")
    members = spread_over_blocks(several.select(*FILE).distinct(), events)
    digests = settle(
        prefix_digests(
            events.select(*FILE, "block", "line_no", "ts_nanos", "sig").join(
                members, [*FILE, "block"], "left_semi"
            )
        ).select(*FILE, "block", "idx", "digest")
    )
    # Whole-file digests: the last event of each file.
    whole = digests.groupBy(*FILE).agg(F.max_by("digest", "idx").alias("digest"))
    keyed = several.join(whole, list(FILE), "left").withColumn(
        "digest", F.coalesce("digest", F.struct(*[F.lit(0).cast("bigint").alias(d) for d in DIGEST]))
    )
    same = keyed.groupBy(*thread, "n_events", "digest").agg(F.min("path").alias("_keeper"), F.max("_max").alias("_max"))
    # Every inner prefix of every file, each (thread, length, digest) once:
    # the distinct runs before the shuffle, so mass copies do not pile up.
    homes = [c for c in FILE if c not in thread]
    inner = spread_over_blocks(several.select(*dict.fromkeys([*thread, *FILE]), "n_events"), digests)
    prefixes = (
        digests.join(inner, [*FILE, "block"])
        .where(F.col("idx") + 1 < F.col("n_events"))
        .select(*thread, (F.col("idx") + 1).alias("n_events"), "digest")
        .distinct()
    )
    begins = same.join(prefixes, [*thread, "n_events", "digest"], "left_semi").select(
        *thread, "_keeper", F.lit(True).alias("_begins")
    )
    verdict = same.join(begins, [*thread, "_keeper"], "left").select(
        *thread,
        "n_events",
        "digest",
        "_keeper",
        (F.coalesce("_begins", F.lit(False)) | ((F.col("n_events") == 0) & (F.col("_max") > 0))).alias("_begins"),
    )
    judged = join_dimension(keyed, verdict, [*thread, "n_events", "digest"], ["path"], "inner").select(
        *thread, *homes, (F.col("_begins") | (F.col("path") != F.col("_keeper"))).alias("_copy")
    )
    return (
        files.join(judged, [*dict.fromkeys([*thread, *homes])], "left")
        .withColumn("is_copy", F.coalesce("_copy", F.lit(False)))
        .withColumn("is_crowded", F.col("_copy").isNotNull())
        .drop("_copy")
    )


def sequential_threads(files: DataFrame, thread: Sequence[str]) -> DataFrame:
    """Per thread: do its files, copies set aside, follow one another?

    In the order of their first events each must start after everything
    before it has ended; otherwise there is no order in which they add up.
    """
    kept = files.where(~F.col("is_copy")).withColumn("_first", F.coalesce("first_ts", F.lit(-(1 << 62))))

    def overlaps(previous, row):
        follows = F.coalesce(row["first_ts"] > previous["max_ts"], F.lit(False))
        return (~follows).cast("bigint")

    folded = fold_neighbours(
        kept, thread, ("_first", "path"), ("first_ts", "max_ts"), {"_overlaps": overlaps}
    )
    return folded.select(*thread, (F.col("_overlaps") == 0).alias("is_sequential"))


def resolve_threads(files: DataFrame, events: DataFrame, thread: Sequence[str]) -> DataFrame:
    """``files`` with ``is_copy`` and ``is_sequential``."""
    marked = settle(mark_copies(files, events, thread))
    # A thread of one file is in order by itself.
    order = sequential_threads(marked.where("is_crowded"), thread)
    return join_dimension(marked, order, thread, ["path"]).withColumn(
        "is_sequential", F.coalesce("is_sequential", F.lit(True))
    ).drop("is_crowded")
