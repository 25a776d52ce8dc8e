from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.timeline import token_events
from tallyspark.plans import catalogue
from tallyspark.plans import refresh as refresh_module
from tallyspark.plans.refresh import log_store, refresh
from tallyspark.plans.usage_report import EVENT_COLUMNS
from tallyspark.sources import byte_log
from tallyspark.sources.event_feed import event_files, event_lines
from tallyspark.sources.log_scan import load_session_logs
from tallyspark.streaming.windows import _Runs, cut_periods, daily_usage, keep_slices, kept_slices, period_usage
from tests.logs import CHILD, Home, meta, model, nanos, usage

OTHER = "b7405d2c-1e8f-4c6a-a0d3-58e2f9176c4b"


def whole(df):
    return sorted((str(r) for r in df.select(*sorted(df.columns)).collect()))


def check(spark, root, state, events=False):
    """A refresh, held against a cold scan; returns it and its changes."""
    run = refresh(spark, root, "UTC", state, buckets=8)
    cold = load_session_logs(spark, root, "UTC")
    assert whole(run.logs.files) == whole(cold.files)
    assert whole(run.logs.lines) == whole(cold.lines)
    if events:
        assert whole(run.events) == whole(token_events(cold.lines).select(*EVENT_COLUMNS))
    return run, sorted(r.change for r in run.changes.collect())


def test_refresh_equals_cold_scan(spark, tmp_path):
    home, state = Home(), str(tmp_path / "state")
    root = str(home.root)
    grown = home.write([meta(0), usage(1, 100, 100)])
    moved = home.write([meta(0, CHILD), usage(1, 50, 50)], thread=CHILD)
    gone = home.write([meta(0, OTHER), usage(1, 9, 9)], thread=OTHER)
    refresh(spark, root, "UTC", state, buckets=8)
    time.sleep(0.01)
    home.write([meta(0), usage(1, 100, 100), usage(2, 150, 50)])
    archive = home.root / "archived_sessions"
    archive.mkdir()
    os.rename(moved, archive / moved.name)
    gone.unlink()
    home.write([meta(0, OTHER), model(0, "m"), usage(1, 7, 7)], thread=OTHER, stamp="13-00-00")
    run, changes = check(spark, root, state, events=True)
    assert changes == ["appended", "deleted", "moved away", "new", "renamed"] and grown.exists()
    again = refresh(spark, root, "UTC", state, buckets=8)
    assert {r.change for r in again.changes.collect()} == {"unchanged"} and not again.changed_buckets
    assert again.run.first()["bytes_read"] == 0


def test_bytes_read_are_bytes_appended(spark, tmp_path):
    """An append costs its own bytes; an open last line waits and is read once it is closed."""
    home, state = Home(), str(tmp_path / "state")
    root = str(home.root)
    big = home.write([meta(0), *[usage(i, 10 * i, 10) for i in range(1, 400)]], tail=json.dumps(usage(400, 4000, 10))[:40])
    other = home.write([meta(0, CHILD), usage(1, 5, 5)], thread=CHILD)
    size = big.stat().st_size
    first = refresh(spark, root, "UTC", state, buckets=8)
    assert first.run.first()["bytes_read"] == size + other.stat().st_size and first.run.first()["events_added"] == 400
    with big.open("ab") as f:
        f.write(json.dumps(usage(400, 4000, 10))[40:].encode() + b"\n" + b"\n\r\n")
    run, _ = check(spark, root, state)
    counts = run.run.first()
    assert counts["bytes_read"] == big.stat().st_size - size < 400 and counts["events_added"] == 1 and counts["files_read"] == 1
    # One bucket is written anew, the other one's generation stays live.
    store = log_store(spark, state, root, "UTC", 8)
    assert len(run.changed_buckets) == 1 and set(store.newest().live["lines"].values()) == {0, 1}


def test_rewritten_and_truncated_files_are_read_again(spark, tmp_path):
    home, state = Home(), str(tmp_path / "state")
    root = str(home.root)
    longer = home.write([meta(0), usage(1, 100, 100), usage(2, 150, 50)])
    home.write([meta(0, CHILD), usage(1, 100, 100), usage(2, 150, 50)], thread=CHILD)
    moved = home.write([meta(0, OTHER), usage(1, 3, 3)], thread=OTHER)
    refresh(spark, root, "UTC", state, buckets=8)
    # Longer than before, but not the same file any more; shorter; moved, with other content of the same length.
    home.write([meta(0), model(1, "m"), *[usage(i, 7 * i, 7) for i in range(1, 9)]])
    cut = home.write([meta(0, CHILD), usage(3, 3, 3)], thread=CHILD)
    other = home.root / "archived_sessions" / moved.name
    other.parent.mkdir()
    other.write_bytes(moved.read_bytes().replace(b'"total_tokens": 3', b'"total_tokens": 8'))
    moved.unlink()
    run, changes = check(spark, root, state)
    assert changes == ["moved away", "rewritten", "rewritten", "rewritten"]
    assert run.run.first()["bytes_read"] == sum(p.stat().st_size for p in (longer, cut, other))


def test_generations_age(spark, tmp_path):
    home, state = Home(), str(tmp_path / "state")
    root = str(home.root)
    for n in range(1, 4):
        home.write([meta(0), *[usage(i, 10 * i, 10) for i in range(1, n + 1)]])
        run = refresh(spark, root, "UTC", state, buckets=4)
    store = log_store(spark, state, root, "UTC", 4)
    entries = store.entries()
    assert [e.number for e in entries] == [0, 1, 2]
    # Readers of an older entry still have its files; a run that died before its entry counts for nothing.
    assert [store.read(e, "events").count() for e in entries] == [1, 2, 3]
    store.write("lines", 3, run.logs.lines.limit(0))
    assert store.newest().number == 2
    assert store.forget(keep_seconds=0) == 8 and [e.number for e in store.entries()] == [2]
    assert store.read(store.newest(), "events").count() == 3 and store.forget(keep_seconds=0) == 0
    with pytest.raises(ValueError):
        refresh(spark, root, "UTC", state, buckets=5)
    assert log_store(spark, state, root + "/other", "UTC").newest() is None


def test_empty_root_and_lost_files(spark, tmp_path, monkeypatch):
    home, state = Home(), str(tmp_path / "state")
    root = str(home.root)
    run = refresh(spark, root, "UTC", state, buckets=8)
    assert run.logs.files.count() == 0 and run.events.count() == 0
    path = home.write([meta(0), usage(1, 100, 100)])
    kept = home.write([meta(0, CHILD), usage(1, 5, 5)], thread=CHILD)
    listed, errors = byte_log.discover(spark, root)
    frozen = byte_log.settle(listed)
    # A file that vanished after it was listed: unread, and tried again by the next run.
    monkeypatch.setattr(refresh_module, "discover", lambda *a: (frozen, errors))
    path.unlink()
    run = refresh(spark, root, "UTC", state, buckets=8)
    files = {r.path.rsplit("/", 1)[1]: r.unread for r in run.logs.files.collect()}
    assert files == {path.name: True, kept.name: False} and run.run.first()["files_failed"] == 1
    monkeypatch.undo()
    home.write([meta(0), usage(1, 100, 100)])
    run, _ = check(spark, root, state)
    assert {r.unread for r in run.logs.files.collect()} == {False}


def test_window_sums_match_their_definition(spark):
    events = spark.createDataFrame(
        [("a", nanos(0), 5, False), ("a", nanos(86_400), 7, True), ("a", nanos(86_401), 1, False), ("b", None, 9, False)],
        "home string, ts_nanos bigint, delta_total bigint, overflow boolean",
    )
    assert {(r.home, str(r.day), r.tokens, r.overflow_tokens) for r in daily_usage(events, "UTC").collect()} == {
        ("a", "2026-08-10", 5, 0), ("a", "2026-08-11", 1, 7)}
    # 12:00 UTC is already the next day far enough east.
    assert {str(r.day) for r in daily_usage(events, "Pacific/Kiritimati").collect()} == {"2026-08-11", "2026-08-12"}
    starts = spark.createDataFrame([("a", nanos(86_400)), ("b", None)], "home string, period_start_nanos bigint")
    assert [(r.home, r.tokens, r.overflow_tokens) for r in period_usage(events, starts).collect()] == [("a", 1, 7)]


def test_period_stream_counts_events_before_their_boundary(spark, tmp_path):
    schema = "home string, ts_nanos bigint, delta_total bigint, overflow boolean"
    second = 10**9
    early = [("a", 10 * second, 5, False), ("a", 20 * second + 7, 6, False), ("a", 20 * second, 1, True)]
    late = [("a", 19 * second + 999, 3, False), ("a", 30 * second, 7, False), ("b", second, 2, False), ("b", None, 9, False)]
    everything = spark.createDataFrame(early + late, schema)
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")

    def run(number, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{number}")
        keep_slices(source, f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()

    def now(boundaries):
        starts = spark.createDataFrame(boundaries, "home string, period_start_nanos bigint")
        got = sorted(map(tuple, cut_periods(kept_slices(spark, f"{tmp_path}/out"), starts).collect()))
        return got, sorted(map(tuple, period_usage(everything, starts).collect()))

    run(0, early)
    run(1, late)
    # The boundaries are known only now, and then move.
    for boundaries in ([("a", 20 * second), ("b", 0)], [("a", 21 * second), ("b", None)], [("a", 0)]):
        got, batch = now(boundaries)
        assert got == batch
    assert now([("a", 20 * second)])[0] == [("a", 20 * second, 13, 1)]


def test_slices_of_many_batches_are_few_runs(spark, tmp_path):
    schema = "home string, ts_nanos bigint, delta_total bigint, overflow boolean"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rows = [("a", (n % 3) * 10**9, n, n % 2 == 0) for n in range(11)]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    keep_slices(source, f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    # 11 batches: runs of 8, 2 and 1; the two halves of the last merge may still be there.
    store = _Runs(spark, f"{tmp_path}/out/slices")
    assert [b - a + 1 for a, b in store.live()] == [8, 2, 1] and len(list((tmp_path / "out" / "slices").iterdir())) <= 7
    got = {(r.home, r.second): (r.tokens, r.overflow_tokens) for r in kept_slices(spark, f"{tmp_path}/out").collect()}
    want = {("a", s): (sum(n for _, t, n, o in rows if t == s * 10**9 and not o), sum(n for _, t, n, o in rows if t == s * 10**9 and o)) for s in range(3)}
    assert got == want
    # A merge that had not removed its halves counts once.
    store.write(store.read([(0, 7)]), 0, 3)
    assert {(r.home, r.second): (r.tokens, r.overflow_tokens) for r in kept_slices(spark, f"{tmp_path}/out").collect()} == want


def test_history_is_restored_from_stored_lines(spark, monkeypatch):
    """Events and files come from the store's lines, which are derived once."""
    given = []
    monkeypatch.setattr(catalogue, "event_files", lambda lines: given.append(lines) or event_files(lines))
    catalogue.QUERIES["restored_history"](spark, "/root/testdata/sf0.001")
    assert given and "get_json_object" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_event_rows_are_dealt_over_tasks(spark):
    """One row group is one task's to read, not to derive lines from."""
    sf = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{sf}/events.parquet").rdd.getNumPartitions() == 1
    parts = event_lines(spark, sf).select(F.spark_partition_id().alias("part")).distinct()
    assert parts.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
