"""Forked sessions: which leading events only replay the parent's history.

A fork starts by repeating snapshots of its parent up to the fork time. Its
leading events are matched greedily, in order, against the parent's snapshots
(gaps in the parent are skipped); the matched prefix is not new usage.

Greedy matching looks sequential, but mostly is not: the n-th time the child
shows a snapshot it can at the earliest match the n-th time the parent showed
it. Where those places rise strictly, they are the greedy matches. So one
equi-join on (fork, snapshot, occurrence) settles everything up to the first
place that does not rise, and only forks with such a place go another round
from there. Each round is spread over (fork, snapshot) and positions.

Forks that still fall back after ``ROUNDS`` rounds (two snapshots that take turns
can do so at every second event) are finished by a walk: the parents' places
stream past in order, sorted by Spark, while ``WALK_EVENTS`` of the fork's next
snapshots are held as hashes. No timeline is ever held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.blocks import (
    before,
    dense_positions,
    join_dimension,
    spread_over_blocks,
)
from tallyspark.operators.carry import FILE
from tallyspark.operators.threads import resolve_threads
from tallyspark.session import settle

FORK = ("home", "fork")
ROUNDS = 20
WALK_EVENTS = 1 << 20


def ancestor_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All (home, thread, ancestor) pairs of the ``start`` threads over parent edges.

    ``edges``: ``home, thread, parent``; ``start``: ``home, thread``. Pairs are
    made for the start threads alone. Jumps over the edges double in every
    round (a row for each thread, not for each pair), so chains of length n
    need log2(n) rounds; when a round finds nothing new, there is no more.
    """
    jump = settle(edges.select("home", "thread", F.col("parent").alias("ancestor")).distinct())
    reach = settle(start.select("home", "thread").distinct().join(jump, ["home", "thread"]))
    while True:
        onward = jump.select("home", F.col("thread").alias("ancestor"), F.col("ancestor").alias("_next"))
        longer = (
            reach.join(onward, ["home", "ancestor"])
            .select("home", "thread", F.col("_next").alias("ancestor"))
            .join(reach, ["home", "thread", "ancestor"], "left_anti")
            .distinct()
        )
        longer = settle(longer)
        if longer.isEmpty():
            return reach
        reach = settle(reach.union(longer))
        jump = settle(jump.join(onward, ["home", "ancestor"]).select("home", "thread", F.col("_next").alias("ancestor")).distinct())


def parent_state(children: DataFrame, files: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each fork may match against.

    ``children``: ``home, path, parent_id, root_ts``. ``files``: every file
    with ``home, path, filename_thread_id, n_events, first_ts, max_ts,
    last_line_ts, uncertain, token_without_timestamp, compacted``. Parents
    are found by the thread id in their file name, whatever their provider.

    Returns the forks with ``usable`` and the parents' kept files. A fork is
    usable when it has a start time, its parent's files are all present, sound
    and in sequence, and one of them reaches the fork time.
    """
    wanted = children.select("home", F.col("parent_id").alias("filename_thread_id")).distinct()
    parents = settle(files.join(wanted, ["home", "filename_thread_id"], "left_semi"))
    sound = ~(F.col("uncertain") | F.col("token_without_timestamp") | F.col("compacted"))
    health = parents.groupBy("home", "filename_thread_id").agg(
        F.bool_and(sound).alias("_sound"), F.max("last_line_ts").alias("_reaches")
    )
    resolved = resolve_threads(parents, events, ("home", "filename_thread_id"))
    order = resolved.groupBy("home", "filename_thread_id").agg(
        F.bool_and("is_sequential").alias("_sequential")
    )
    state = health.join(order, ["home", "filename_thread_id"]).withColumnRenamed(
        "filename_thread_id", "parent_id"
    )
    judged = join_dimension(children, state, ["home", "parent_id"], ["path"]).withColumn(
        "usable",
        F.coalesce(
            F.col("root_ts").isNotNull()
            & F.col("_sound")
            & F.col("_sequential")
            & (F.col("_reaches") >= F.col("root_ts")),
            F.lit(False),
        ),
    )
    kept = resolved.where(~F.col("is_copy")).select(
        "home", "path", F.col("filename_thread_id").alias("parent_id"), "first_ts"
    )
    return judged.drop("_sound", "_sequential", "_reaches"), kept


def replay_bounds(forks: DataFrame, parent_files: DataFrame, events: DataFrame) -> DataFrame:
    """Last replayed line per fork: ``home, fork, replayed_events, replay_line_no``.

    ``forks``: ``home, path, parent_id, root_ts``. Forks that replay nothing
    are absent. ``events`` is the table of token events (``sig``).
    """
    slim = events.select(*FILE, "block", "line_no", "ts_nanos", "sig")
    fork_rows = forks.select("home", "path", "parent_id", "root_ts")
    child = slim.join(spread_over_blocks(fork_rows, slim), [*FILE, "block"])
    child = settle(
        dense_positions(child, FILE).select(
            "home", F.col("path").alias("fork"), "parent_id", "root_ts", "idx", "line_no", "block", "sig"
        )
    )
    wanted = child.select("home", "fork", "parent_id", "root_ts", "sig").distinct()
    parent = slim.join(spread_over_blocks(parent_files, slim), [*FILE, "block"])
    # Places in the parents' chained history that show a wanted snapshot.
    place = F.struct("first_ts", "path", "line_no")
    seen = settle(
        parent.select("home", "parent_id", "sig", "ts_nanos", place.alias("place"), "block")
        .join(wanted, ["home", "parent_id", "sig"])
        .where(F.col("ts_nanos") <= F.col("root_ts"))
        .select("home", "fork", "sig", "place", "block")
    )
    reached = None  # where the previous round stopped: home, fork, next_idx, at
    finished = []
    for _ in range(ROUNDS):
        todo, spots = child, seen
        if reached is not None:
            todo = join_dimension(todo, reached, FORK, ["idx"], "inner").where(F.col("idx") >= F.col("next_idx"))
            spots = join_dimension(spots, reached, FORK, ["place"], "inner").where(F.col("place") > F.col("at"))
        stops = settle(_match_round(todo, spots))
        again = settle(_can_continue(stops, child, seen))
        finished.append(stops.join(again, list(FORK), "left_anti"))
        if again.isEmpty():
            break
        reached = again.select(*FORK, "next_idx", "at")
    else:
        finished += _walk(child, seen, reached)
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    last = result.where(F.col("next_idx") > 0).select(
        *FORK, F.col("next_idx").alias("replayed_events"), (F.col("next_idx") - 1).alias("idx")
    )
    return last.join(child.select(*FORK, "idx", "line_no"), [*FORK, "idx"]).select(
        *FORK, "replayed_events", F.col("line_no").alias("replay_line_no")
    )


def _occurrence(df: DataFrame, order: str, block_order: Sequence[str]) -> DataFrame:
    """Number equal snapshots of a fork, block by block."""
    key = [*FORK, "sig"]
    counts = df.groupBy(*key, *block_order).agg(F.count(F.lit(1)).alias("_n"))
    earlier = before(Window.partitionBy(*key).orderBy(*block_order))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*key, *block_order).orderBy(order))
    return (
        df.withColumn("_rn", local)
        .join(offsets, [*key, *block_order])
        .withColumn("nth", F.col("_rn") + F.col("_offset"))
        .drop("_rn", "_offset")
    )


def _match_round(todo: DataFrame, spots: DataFrame) -> DataFrame:
    """Per fork: first index not matched in this round, and the last place used."""
    left = _occurrence(todo.select(*FORK, "idx", "block", "sig"), "idx", ("block",))
    right = _occurrence(
        spots.select(*FORK, "sig", "place", "block", F.col("place.first_ts").alias("_f"), F.col("place.path").alias("_p")),
        "place",
        ("_f", "_p", "block"),
    ).select(*FORK, "sig", "nth", "place")
    matched = settle(left.join(right, [*FORK, "sig", "nth"], "left").select(*FORK, "idx", "place"))
    previous = matched.select(*FORK, (F.col("idx") + 1).alias("idx"), F.col("place").alias("_before"), F.lit(True).alias("_has"))
    checked = matched.join(previous, [*FORK, "idx"], "left")
    rises = F.col("place").isNotNull() & (
        F.col("_has").isNull() | F.coalesce(F.col("place") > F.col("_before"), F.lit(False))
    )
    stops = checked.groupBy(*FORK).agg(
        F.min(F.when(~rises, F.col("idx"))).alias("_bad"), F.max("idx").alias("_end"), F.min("idx").alias("_start")
    )
    stops = stops.select(*FORK, "_start", F.coalesce(F.col("_bad"), F.col("_end") + 1).alias("next_idx"))
    used = matched.select(*FORK, (F.col("idx") + 1).alias("next_idx"), F.col("place").alias("at"))
    return stops.join(used, [*FORK, "next_idx"], "left").select(*FORK, "next_idx", "at")


def _can_continue(stops: DataFrame, child: DataFrame, seen: DataFrame) -> DataFrame:
    """Forks whose next snapshot still occurs after the last place used."""
    stuck = stops.where(F.col("at").isNotNull()).join(
        child.select(*FORK, F.col("idx").alias("next_idx"), "sig"), [*FORK, "next_idx"]
    )
    later = seen.select(*FORK, "sig", F.col("place").alias("_later"))
    a, b = stuck.alias("a"), later.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*FORK, "sig")]
    return a.join(b, [*same, F.col("b._later") > F.col("a.at")], "left_semi")


def _walk(child: DataFrame, seen: DataFrame, reached: DataFrame) -> list[DataFrame]:
    """Finish forks one place after the other; returns tables like ``_match_round``'s.

    A pass takes ``WALK_EVENTS`` events of every fork; forks that matched all of
    them go another pass.
    """
    keys = [F.xxhash64("sig").alias("s1"), F.xxhash64(F.lit(1), "sig").alias("s2")]
    done = []
    while True:
        step = F.col("idx").between(F.col("next_idx"), F.col("next_idx") + WALK_EVENTS - 1)
        wanted = join_dimension(child, reached, FORK, ["idx"], "inner").where(step)
        nothing = F.lit(None).cast(seen.schema["place"].dataType)
        wanted = wanted.select(*FORK, F.lit(0).alias("side"), nothing.alias("place"), "idx", *keys)
        spots = join_dimension(seen, reached, FORK, ["place"], "inner").where(F.col("place") > F.col("at"))
        spots = spots.select(*FORK, F.lit(1).alias("side"), "place", F.lit(None).cast("bigint").alias("idx"), *keys)
        order = ["side", "idx", "place"]
        rows = wanted.union(spots).repartition(*FORK).sortWithinPartitions(*FORK, *order)
        rows = rows.select(*FORK, "side", "idx", "s1", "s2", "place.first_ts", "place.path", "place.line_no")
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        out = f"home {types['home']}, fork {types['fork']}, next_idx bigint, first_ts {types['first_ts']}, path {types['path']}, line_no {types['line_no']}"
        walked = rows.mapInArrow(_follow, out)
        place = F.struct("first_ts", "path", "line_no").alias("_at")
        moved = reached.join(walked.select(*FORK, F.col("next_idx").alias("_to"), place), list(FORK), "left")
        ends = settle(moved.select(*FORK, F.coalesce("_to", "next_idx").alias("next_idx"), F.coalesce("_at", "at").alias("at"), (F.col("_to") - F.col("next_idx")).alias("_n")))
        more = settle(ends.where(F.col("_n") == WALK_EVENTS).drop("_n"))
        done.append(ends.drop("_n").join(more, list(FORK), "left_anti"))
        if more.isEmpty():
            return done
        reached = more


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fork that gets on: the first event not matched, and the last place used."""
    fork, wanted, at, first, last = None, [], 0, 0, None
    fields: dict[str, pa.DataType] = {}

    def result() -> Iterator[pa.RecordBatch]:
        if at:
            row = {"home": fork[0], "fork": fork[1], "next_idx": first + at, "first_ts": last[0], "path": last[1], "line_no": last[2]}
            yield pa.RecordBatch.from_arrays([pa.array([v], fields[k]) for k, v in row.items()], list(row))

    for batch in batches:
        fields = {n: batch.schema.field(n).type for n in ("home", "fork", "first_ts", "path", "line_no")} | {"next_idx": pa.int64()}
        columns = [batch[c].to_pylist() for c in ("home", "fork", "side", "idx", "s1", "s2", "first_ts", "path", "line_no")]
        for home, kid, side, idx, s1, s2, first_ts, path, line_no in zip(*columns, strict=True):
            if (home, kid) != fork:
                yield from result()
                fork, wanted, at, first, last = (home, kid), [], 0, idx, None
            if side == 0:
                wanted.append((s1, s2))
            elif at < len(wanted) and wanted[at] == (s1, s2):
                at += 1
                last = (first_ts, path, line_no)
    yield from result()
