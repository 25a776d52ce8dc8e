from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.json_fields import rfc3339_nanos
from tallyspark.operators.timeline import token_events
from tallyspark.sources.log_scan import lines_of_index, load_session_logs, read_index
from tallyspark.sources.session_logs import date_folder_of, load_with_readers, thread_id_of
from tests.logs import CHILD, PARENT, Home, meta, model, settings, usage


def run(spark, home):
    logs = load_session_logs(spark, str(home.root), "UTC")
    return logs, token_events(logs.lines)


CASES = {
    "two events": ([meta(0), usage(1, 100, 100), usage(2, 150, 50)], [100, 50]),
    "repeat of a source": ([meta(0), usage(1, 100, 100), usage(2, 200, 100, source="other"), usage(3, 100, 100)], [100, 100, 0]),
    "adjacent repeat across sources": ([meta(0), usage(1, 100, 100), usage(2, 100, 100, source="other")], [100, 0]),
    "recovery below the peak": ([meta(0), usage(1, 100, 100), usage(2, 50, 20), usage(3, 80, 30)], [100, 0, 0]),
    "recovery past the peak": ([meta(0), usage(1, 100, 100), usage(2, 50, 20), usage(3, 200, 100)], [100, 0, 100]),
    "lower total on another source": ([meta(0), usage(1, 100, 100), usage(2, 50, 50, source="other")], [100, 50]),
    "no last": ([meta(0), usage(1, 100), usage(2, 150)], [100, 50]),
    "total only": ([meta(0), usage(1, {"total_tokens": 100}), usage(2, {"total_tokens": 130})], [100, 30]),
    "same total, different last": ([meta(0), usage(1, 100, 100), usage(2, 100, 40)], [100, 0]),
    "model switch, same counters": (
        [meta(0), model(0, "a"), usage(1, 100, 100), model(2, "b"), usage(3, 100, 100)],
        [100, 100],
    ),
    "no counters": ([meta(0), usage(1, {"cache_write_input_tokens": 5}), usage(2, 100, 100)], [100]),
    "numbers as text are no numbers": (
        [meta(0), usage(1, {"total_tokens": "100"}), usage(2, {"total_tokens": 100.0}), usage(3, {"total_tokens": 7})],
        [7],
    ),
}


def test_deltas(spark):
    """All cases as files of one home: one run, one thread per case."""
    home = Home()
    ids = {name: f"{i:08d}-4c5e-4f00-9ab1-7d6e5f4c3b2a" for i, name in enumerate(CASES)}
    for name, (records, _) in CASES.items():
        home.write(records, thread=ids[name])
    _, events = run(spark, home)
    got: dict[str, list[int]] = {}
    for row in events.select(thread_id_of(F.col("path")).alias("t"), "line_no", "delta_total").orderBy("t", "line_no").collect():
        got.setdefault(row.t, []).append(int(row.delta_total))
    assert {name: got[ids[name]] for name in CASES} == {name: expected for name, (_, expected) in CASES.items()}


def test_saturating_counters(spark):
    top = 2**64 - 1
    home = Home()
    home.write([meta(0), usage(1, None, {"input_tokens": top, "output_tokens": top})])
    _, events = run(spark, home)
    row = events.collect()[0]
    assert int(row.delta_total) == top and int(row.delta_uncached) == top


def test_unterminated_line_waits(spark):
    import json

    home = Home()
    path = home.write([meta(0), "", usage(1, 100, 100)], tail=json.dumps(usage(2, 200, 100)))
    logs, events = run(spark, home)
    assert [int(r.delta_total) for r in events.collect()] == [100]
    path.write_bytes(path.read_bytes() + b"\r\n")
    _, events = run(spark, home)
    assert sum(int(r.delta_total) for r in events.collect()) == 200


def test_tiers(spark):
    home = Home()
    home.write(
        [
            meta(0),
            usage(1, 10, 10),
            model(2, "a", service_tier="priority"),
            usage(3, 20, 10),
            model(4, "b"),
            usage(5, 30, 10),
            settings(6, service_tier="flex"),
            usage(7, 40, 10),
            settings(8),
            usage(9, 50, 10),
            settings(10, service_tier=1),
            usage(11, 60, 10),
            model(12, "", service_tier=None),
            usage(13, 70, 10),
            settings(14, service_tier=""),
            usage(15, 80, 10),
        ]
    )
    _, events = run(spark, home)
    got = [(r.model, r.tier_kind, r.tier_text) for r in events.orderBy("line_no").collect()]
    assert got == [
        (None, None, None),
        ("a", "fast", "priority"),
        ("b", "fast", "priority"),
        ("b", "unknown", "flex"),
        ("b", None, None),
        ("b", "unknown", "1"),
        ("b", None, None),
        ("b", "unknown", ""),
    ]


def test_bad_lines_and_health(spark):
    home = Home()
    home.write([meta(0), '{"broken "turn_context"', usage(1, 100, 100)], thread=PARENT)
    home.write([meta(0, CHILD), '{"cut": "token_count"', b'\xff"token_count"'], thread=CHILD)
    record = usage(1, 50, 50)
    del record["timestamp"]
    third = "b7405d2c-1e8f-4c6a-a0d3-58e2f9176c4b"
    home.write([meta(0, third), record], thread=third)
    logs, _ = run(spark, home)
    rows = {r.thread_id: r for r in logs.files.collect()}
    assert (rows[PARENT].parse_errors, rows[PARENT].uncertain) == (1, False)
    assert (rows[CHILD].parse_errors, rows[CHILD].uncertain) == (2, True)
    assert rows[third].token_without_timestamp and not rows[PARENT].token_without_timestamp
    assert "value" not in logs.lines.columns


def test_roots(spark):
    home = Home()
    ids = [f"{i}{i}{i}{i}{i}{i}{i}{i}-4c5e-4f00-9ab1-7d6e5f4c3b2a" for i in range(3, 8)]
    home.write([meta(0, ids[0], forked_from_id=PARENT), meta(1, ids[0], provider="x")], thread=ids[0])
    home.write([meta(0, ids[1], forked_from_id=PARENT, parent_thread_id=CHILD)], thread=ids[1])
    home.write([meta(0, "other-id")], thread=ids[2])
    home.write(
        [meta(0, ids[3], provider=None, source={"subagent": {"thread_spawn": {"parent_thread_id": PARENT}}})], thread=ids[3]
    )
    home.write([meta(0, ids[4], forked_from_id=ids[4])], thread=ids[4])
    home.write([usage(0, 1, 1)], thread="no-thread-here")
    logs, _ = run(spark, home)
    rows = {r.thread_id: (r.parent_kind, r.parent_id, r.provider, r.has_root) for r in logs.files.collect()}
    assert rows[ids[0]] == ("parent", PARENT, "openai", True)
    assert rows[ids[1]] == ("ambiguous", None, "openai", True)
    assert rows[ids[2]][0] == "ambiguous"
    assert rows[ids[3]] == ("parent", PARENT, None, True)
    assert rows[ids[4]][0] == "ambiguous"
    assert rows[None] == ("none", None, None, False)


def test_quota_fields(spark):
    home = Home()
    home.write(
        [
            meta(0),
            usage(1, info=False, primary=12.5, balance=575.017247, secondary={"used_percent": 3}),
            usage(2, 10, 10, source="elsewhere", primary=99.0, balance=3.0),
            usage(3, 20, 10, primary={"used_percent": 40}),
        ]
    )
    logs, events = run(spark, home)
    rows = logs.lines.where("kind = 'token'").orderBy("line_no").collect()
    assert rows[0].balance == 575.017247 and not rows[0].is_token
    assert rows[0].limits.primary.used_percent == 12.5 and rows[0].limits.secondary is None
    assert rows[1].limits is None and rows[1].balance is None and rows[1].primary_percent is None
    assert rows[2].limits is None and rows[2].primary_percent == 40.0


def test_discovery_depth(spark):
    home = Home()
    home.write([meta(0)], day="2026/08/10")
    home.write([meta(0)], day="a/b/c/d", thread=CHILD)
    home.write([meta(0)], archived=True, thread=CHILD)
    logs, _ = run(spark, home)
    paths = sorted(r.path.split(home.root.name)[1] for r in logs.files.select("path").collect())
    assert len(paths) == 2 and paths[0].startswith("/archived_sessions/") and paths[1].startswith("/sessions/2026/08/10/")
    assert {r.home.rsplit("/", 1)[1] for r in logs.files.select("home").collect()} == {home.root.name}


def test_name_parts(spark):
    rows = spark.createDataFrame(
        [
            (f"/h/sessions/2026/08/10/rollout-2026-08-10T10-49-29-{PARENT}_{CHILD}.jsonl",),
            (f"/h/sessions/{PARENT.upper()}.jsonl",),
            ("/h/sessions/rollout-xx.jsonl",),
        ],
        "p string",
    )
    got = rows.select(thread_id_of(F.col("p")).alias("t"), date_folder_of(F.col("p")).cast("string").alias("d")).collect()
    assert [r.t for r in got] == [PARENT, PARENT, None]
    assert [r.d for r in got] == ["2026-08-10", None, None]


def test_timestamps(spark):
    texts = {
        "2026-08-10T12:00:00Z": 1786363200 * 10**9,
        "2026-08-10T14:00:00.123456789+02:00": 1786363200123456789,
        "2026-08-10t12:00:00.5z": 1786363200500000000,
        "2026-08-10T12:00:00.1234567Z": 1786363200123456700,
        "2026-08-11T08:00:00.000000001+20:00": 1786363200000000001,
        "1969-12-31T23:59:59.999999999Z": -1,
        "2026-02-30T12:00:00Z": None,
        "2026-08-10T12:00:00": None,
        "2400-01-01T00:00:00Z": None,
        "2026-08-10 12:00": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r.t: r.n for r in df.select("t", rfc3339_nanos(F.col("t")).alias("n")).collect()}
    assert got == texts


def test_splits_keep_file_order(spark, monkeypatch):
    """Many splits and blocks of one file: same numbers as one split, with either reader."""
    from tallyspark.sources import byte_log

    records = [meta(0)]
    total = 0
    for i in range(300):
        total += 11
        records.append(usage(i, total, 11, primary=float(i % 101)))
    home = Home()
    home.write(records)
    logs, whole = run(spark, home)
    expected = whole.agg(F.sum("delta_total"), F.count_if("overflow")).collect()[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        pieces = token_events(load_with_readers(spark, str(home.root), "UTC").lines)
        assert pieces.select("block").distinct().count() > 3
        assert pieces.agg(F.sum("delta_total"), F.count_if("overflow")).collect()[0] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    places = sorted((r.line_no, r.ts_nanos) for r in logs.lines.collect())
    monkeypatch.setattr(byte_log, "BLOCK_BYTES", 4096)
    ranges = logs.files.select("path", F.lit(0).cast("bigint").alias("from_byte"), F.col("length").alias("to_byte"))
    cut = lines_of_index(read_index(ranges, split_bytes=1000))
    assert cut.select("block").distinct().count() > 3 and sorted((r.line_no, r.ts_nanos) for r in cut.collect()) == places
    assert token_events(cut).agg(F.sum("delta_total"), F.count_if("overflow")).collect()[0] == expected


def test_homes_that_listings_skip_or_encode(spark):
    """Dot and underscore folders, spaces, percent and glob signs: no account vanishes, all count alike."""
    top = Home()
    names = ["plain", "john doe", "ann/.codex", "_svc", "50% off", "a+b", "x[1]{2}", "größe", ".deep/_er/home"]
    for name in names:
        sub = Home()
        sub.root = top.root / name
        sub.write([meta(0), usage(1, 100, 100)])
    odd = Home()
    odd.root = top.root / "odd"
    seen = odd.write([meta(0), usage(1, 100, 100)], day="2026/08/.11")
    hidden = seen.with_name(".hidden.jsonl")
    seen.parent.joinpath(hidden.name).write_bytes(seen.read_bytes())
    logs = load_session_logs(spark, str(top.root), "UTC")
    files = {(r.home.split(top.root.name + "/")[1], r.path.rsplit("/", 1)[1][0] == "."): r for r in logs.files.collect()}
    assert {h for h, _ in files} == {*names, "odd"}
    assert all(r.has_root and not r.unread for (_, is_hidden), r in files.items() if not is_hidden)
    assert files[("odd", True)].has_root and not files[("odd", True)].unread
    # No reader of Spark opens a hidden file: there it is listed and said to be unread.
    read = {(r.home.split(top.root.name + "/")[1], r.path.rsplit("/", 1)[1][0] == "."): r for r in load_with_readers(spark, str(top.root), "UTC").files.collect()}
    assert read.keys() == files.keys() and read[("odd", True)].unread and not read[("odd", True)].has_root
    sums = {r.home.split(top.root.name + "/")[1]: r.n for r in token_events(logs.lines).groupBy("home").agg(F.sum("delta_total").alias("n")).collect()}
    assert {h: int(n) for h, n in sums.items()} == {h: 100 for h in names} | {"odd": 200}
    assert logs.discovery.count() == 0
    only = load_session_logs(spark, str(top.root), "UTC", homes=[str(top.root / "john doe")])
    assert [r.home.rsplit("/", 1)[1] for r in only.files.collect()] == ["john doe"]


def test_unlisted_folders_and_empty_roots(spark, tmp_path):
    from tallyspark.sources.session_logs import LogFolders, discovery_errors

    failed = LogFolders([], [], ["/logs/ann/sessions/2026", "/logs/ann/sessions/2027", "/logs/bob"])
    got = {(r.home, r.errors) for r in discovery_errors(spark, failed).collect()}
    assert got == {("/logs/ann", 2), ("/logs/bob", 1)}
    logs = load_session_logs(spark, str(tmp_path), "UTC")
    assert logs.files.count() == 0 and logs.lines.count() == 0
