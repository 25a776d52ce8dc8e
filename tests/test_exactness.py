"""Distributed forms against plain sequential ones, with tiny blocks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyspark.operators import blocks, forks
from tallyspark.operators.blocks import fold_neighbours, ordered_slices, running
from tallyspark.operators.carry import carry_settings
from tallyspark.operators.compaction import compact_events
from tallyspark.operators.deltas import flatten_events, token_timeline
from tallyspark.operators.forks import replay_bounds
from tallyspark.operators.threads import file_profile, mark_copies
from tallyspark.operators.timeline import token_events
from tallyspark.session import settle
from tallyspark.sources.event_feed import event_lines
from tallyspark.streaming.parse_state import FileState, stream_lines

SF = "/root/testdata/sf0.001"
KEPT = ("model", "tier_kind", "tier_text", "is_duplicate", "is_stale", "overflow", "delta_total", "delta_uncached", "delta_cached", "delta_output")


def test_timeline_in_blocks_equals_one_pass(spark):
    lines = event_lines(spark, SF, variants=True, block_rows=60)
    got = {(r.path, r.line_no): tuple(r[c] for c in KEPT) for r in token_events(lines).select("path", "line_no", *KEPT).collect()}
    files: dict[str, list[dict]] = {}
    for row in stream_lines(lines).orderBy("path", "line_no").collect():
        files.setdefault(row.path, []).append(row.asDict())
    expected = {}
    for path, rows in files.items():
        state, peaks = FileState(), {}
        for row in rows:
            state.settings(row)
            if row["is_token"]:
                out, raised = state.event(row, peaks.get(row["source"]))
                if raised:
                    peaks[row["source"]] = raised
                v = {**state.values, **out}
                expected[path, row["line_no"]] = tuple(v[c] for c in KEPT)
    assert got == expected


def test_peaks_survive_model_changes_across_blocks(spark):
    rng = random.Random(5)
    counter = "struct<input:bigint,cached_input:bigint,cache_write_input:bigint,output:bigint,reasoning_output:bigint,total:bigint>"
    schema = (
        f"home string, path string, line_no bigint, ts_nanos bigint, model_set string, sets_tier boolean, tier_set_kind string, tier_set_text string,"
        f"is_token boolean, source string, total {counter}, last {counter}, primary_percent double, secondary_percent double"
    )
    rows = []
    for path in range(12):
        for n in range(120):
            def side(chance):
                if rng.random() > chance:
                    return None
                return tuple(rng.choice([None, rng.randrange(6)]) for _ in range(5)) + (rng.choice([None, rng.randrange(8)]),)
            total, last = side(0.8), side(0.7)
            is_token = rng.random() < 0.85 and (total is not None or last is not None)
            rows.append(("h", f"p{path}", n, n, None if is_token else rng.choice("ab"), False, None, None, is_token,
                         rng.choice([None, "x", "y"]), total, last, rng.choice([None, 50.0, 100.0]), None))
    frame = spark.createDataFrame(rows, schema)
    results = []
    for size in (5, 1000):
        lines = frame.withColumn("block", F.expr(f"line_no div {size}"))
        found = token_timeline(settle(flatten_events(carry_settings(lines).where("is_token"))))
        results.append({(r.path, r.line_no): tuple(r[c] for c in KEPT[3:]) for r in found.collect()})
    assert results[0] == results[1]
    for path in range(12):
        state, peaks = FileState(), {}
        for row in stream_lines(lines.where(F.col("path") == f"p{path}")).orderBy("line_no").collect():
            row = row.asDict()
            state.settings(row)
            if row["is_token"]:
                out, raised = state.event(row, peaks.get(row["source"]))
                if raised:
                    peaks[row["source"]] = raised
                assert results[0][f"p{path}", row["line_no"]] == tuple(out[c] for c in KEPT[3:])


def greedy(child, parent):
    at = matched = 0
    for sig in child:
        try:
            at = parent.index(sig, at) + 1
        except ValueError:
            break
        matched += 1
    return matched


def test_fork_replay_is_greedy_matching(spark):
    rng = random.Random(3)
    rows, forks, expected = [], [], {}
    for n in range(25):
        parent = [rng.choice("abcd") for _ in range(30)]
        picked = sorted(rng.sample(range(30), rng.randrange(1, 20)))
        child = [parent[i] for i in picked] + [rng.choice("abcdz") for _ in range(6)]
        cutoff = rng.randrange(5, 40)
        times = [i + rng.randrange(3) for i in range(30)]
        rows += [("h", f"par{n}", i // 7, i, t, s) for i, (t, s) in enumerate(zip(times, parent, strict=True))]
        rows += [("h", f"kid{n}", i // 4, i, 100 + i, s) for i, s in enumerate(child)]
        forks.append(("h", f"kid{n}", f"par{n}", cutoff))
        expected[f"kid{n}"] = greedy(child, [s for t, s in zip(times, parent, strict=True) if t <= cutoff])
    events = settle(spark.createDataFrame(rows, "home string, path string, block bigint, line_no bigint, ts_nanos bigint, sig string"))
    children = spark.createDataFrame(forks, "home string, path string, parent_id string, root_ts bigint")
    parents = children.select("home", F.col("parent_id").alias("path"), "parent_id", F.lit(0).cast("bigint").alias("first_ts"))
    got = {r.fork: (r.replayed_events, r.replay_line_no) for r in replay_bounds(children, parents, events).collect()}
    assert got == {k: (v, v - 1) for k, v in expected.items() if v}


def test_forks_that_fall_back_at_every_place(spark, monkeypatch):
    """Two snapshots that take turns: few rounds, then a walk in passes, and still the greedy matches."""
    rounds = []
    real = forks._match_round
    monkeypatch.setattr(forks, "ROUNDS", 3)
    monkeypatch.setattr(forks, "WALK_EVENTS", 40)
    monkeypatch.setattr(forks, "_match_round", lambda *a: (rounds.append(1), real(*a))[1])
    shapes = {"alternate": ("ab" * 60, "aabb" * 40), "short": ("ab" * 90, "aabb" * 30), "plain": ("abcd", "xabcd"), "none": ("z", "ab")}
    rows, kids = [], []
    for name, (child, parent) in shapes.items():
        rows += [("h", f"par-{name}", i // 50, i, i, s) for i, s in enumerate(parent)]
        rows += [("h", f"kid-{name}", i // 50, i, 1000 + i, s) for i, s in enumerate(child)]
        kids.append(("h", f"kid-{name}", f"par-{name}", 999))
    events = settle(spark.createDataFrame(rows, "home string, path string, block bigint, line_no bigint, ts_nanos bigint, sig string"))
    children = spark.createDataFrame(kids, "home string, path string, parent_id string, root_ts bigint")
    parents = children.select("home", F.col("parent_id").alias("path"), "parent_id", F.lit(0).cast("bigint").alias("first_ts"))
    got = {r.fork: r.replayed_events for r in replay_bounds(children, parents, events).collect()}
    assert got == {f"kid-{n}": v for n, (c, p) in shapes.items() if (v := greedy(c, list(p)))}
    assert len(rounds) == 3 and max(got.values()) == 80


def test_only_hot_keys_are_spread(spark, monkeypatch):
    facts = settle(spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("k"), "id"))
    dim = spark.createDataFrame([(7, "hot"), (2500, "cold"), (9999, "none")], "k long, name string")
    want = sorted(facts.join(dim, "k", "left").collect())
    assert blocks.hot_keys(facts, ["k"]) == {}
    monkeypatch.setattr(blocks, "COLD_BYTES", 0)
    monkeypatch.setattr(blocks, "HOT_ROWS", 300)
    hot = blocks.hot_keys(facts, ["k"])
    assert list(hot.values()) == [7]
    joined = blocks.join_dimension(facts, dim, ["k"], ["id"])
    assert sorted(joined.collect()) == want
    # The one hot key has seven rows on the dimension's side, a cold key its own.
    sizes = [r["n"] for r in joined.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").collect()]
    assert sizes == [999, 1, 2000]
    assert sorted(blocks.join_dimension(facts, dim, ["k"], ["id"], "inner").collect()) == sorted(facts.join(dim, "k").collect())


def test_copies_in_small_blocks(spark):
    rows = []
    contents = {"a": "abcdefgh", "b": "abcdefgh", "c": "abc", "d": "abd", "e": "", "f": "abcdefghi", "g": "abd", "h": "xbcdefgh"}
    for path, sigs in contents.items():
        rows += [("h", path, "t", i // 2, i, i, s) for i, s in enumerate(sigs)]
    rows += [("h", "solo", "u", 0, 0, 0, "q")]
    events = settle(spark.createDataFrame(rows, "home string, path string, thread_id string, block bigint, line_no bigint, ts_nanos bigint, sig string"))
    listed = spark.createDataFrame([("h", p, "t") for p in contents] + [("h", "solo", "u"), ("h", "e2", "v"), ("h", "e1", "v")], "home string, path string, thread_id string")
    files = settle(listed.join(file_profile(events), ["home", "path"], "left").fillna(0, ["n_events"]))
    got = {r.path: r.is_copy for r in mark_copies(files, events, ("home", "thread_id")).collect()}
    copies = {"a", "b", "c", "e", "g", "e2"}
    assert got == {p: p in copies for p in [*contents, "solo", "e1", "e2"]}


def test_neighbours_and_running_over_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _neighbours_and_running(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _neighbours_and_running(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(50), i, float(rng.randrange(100))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v double").repartition(6)
    folded = fold_neighbours(df, ["k"], ("t", "i"), ("v",), {"s": lambda a, b: F.greatest(a["v"] - b["v"], F.lit(0.0))})
    sliced = ordered_slices(df, ["k"], ("t", "i"))
    assert sliced.where("k = 'hot'").select("block").distinct().count() > 1
    run = running(sliced, ["k"], ("t", "i"), {"before": ("last", F.col("v"), False), "top": ("max", F.col("v"), True), "all": ("sum", F.col("v"), True)})
    got = {r.i: (r.before, r.top, r.all) for r in run.collect()}
    sums, expected = {}, {}
    for key in "hot", "a", "b":
        series = sorted((t, i, v) for k, t, i, v in rows if k == key)
        sums[key] = sum(max(a[2] - b[2], 0.0) for a, b in zip(series, series[1:]))
        top, total, last = None, 0.0, None
        for _, i, v in series:
            top, total = v if top is None else max(top, v), total + v
            expected[i] = (last, top, total)
            last = v
    assert {r.k: r.s for r in folded.collect()} == sums
    assert got == expected


def test_compaction_keeps_what_later_events_need(spark):
    def sig(total):
        return (total, None, None, 0, None, total)

    counter = "struct<input:bigint,cached_input:bigint,cache_write_input:bigint,output:bigint,reasoning_output:bigint,total:bigint>"
    schema = f"home string, path string, block bigint, line_no bigint, ts_nanos bigint, source string, model string, total {counter}"
    totals = [("main", 500), ("other", 400), (None, 200), ("main", 550), ("other", 300), (None, 450), ("main", 150)]
    rows = [("h", "p", i // 2, i, i, s, "m", sig(t)) for i, (s, t) in enumerate(totals)] + [("h", "p", 3, 7, 100, "main", "m", sig(600)), ("h", "p", 4, 8, 5, "main", "m", sig(610))]
    events = settle(spark.createDataFrame(rows, schema))
    files = spark.createDataFrame([("h", "p", 50)], "home string, path string, start_nanos bigint")
    kept = sorted(r.line_no for r in compact_events(events, files).collect())
    # Peaks of the three sources, the event before the start, all from it on.
    assert kept == [1, 3, 5, 6, 7, 8]


def test_closure_of_a_long_chain(spark):
    from tallyspark.operators.forks import ancestor_closure

    edges = spark.createDataFrame([("h", i, i - 1) for i in range(1, 101)] + [("h", 201, 200)], "home string, thread long, parent long")
    start = spark.createDataFrame([("h", 100), ("h", 3)], "home string, thread long")
    got = {(r.thread, r.ancestor) for r in ancestor_closure(edges, start).collect()}
    assert got == {(100, k) for k in range(100)} | {(3, k) for k in range(3)}


def test_intermediates_need_a_shared_folder_on_a_cluster():
    import pytest

    from tallyspark import session

    assert session.is_one_process("local[4]") and not session.is_one_process("local-cluster[2,1,1024]") and not session.is_one_process("yarn")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
