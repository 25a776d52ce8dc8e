"""Whole reports from log files; every case is one home of a single run."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.pricing import price_frame
from tallyspark.plans import catalogue
from tallyspark.plans.usage_report import report_issues, usage_report, usage_tables, window_report
from tallyspark.sources.log_scan import load_session_logs
from tests.logs import BASE, CHILD, PARENT, Home, meta, model, nanos, settings, usage

DAY = 86_400
OTHER = "b7405d2c-1e8f-4c6a-a0d3-58e2f9176c4b"
DEFAULT_START = -3_600


def fork(home, parent_tail=True):
    home.write([meta(0), usage(1, 100, 100), *([model(10, "m")] if parent_tail else [])])
    home.write([meta(2, CHILD, forked_from_id=PARENT), usage(3, 100, 100), usage(4, 150, 50)], thread=CHILD)


def resumed_fork(home):
    home.write([meta(0), usage(1, 100, 100)])
    home.write([meta(10), usage(11, 50, 50), model(20, "m")], suffix=f"_{OTHER}")
    home.write([meta(12, CHILD, parent_thread_id=PARENT), usage(13, 100, 100), usage(14, 50, 50), usage(15, 130, 30)], thread=CHILD)


def skipping_fork(home):
    """The child leaves out parent events and meets a repeated snapshot late."""
    events = [usage(i, 100, 100, source=s) for i, s in enumerate(("a", "b"), 1)] + [usage(3, 200, 100), usage(4, 100, 100), usage(5, 300, 100)]
    home.write([meta(0), *events, model(30, "m")])
    child = [usage(11, 200, 100), usage(12, 100, 100), usage(13, 300, 100), usage(14, 340, 40)]
    home.write([meta(10, CHILD, forked_from_id=PARENT), *child], thread=CHILD)


def copies(home, conflict=False, many=1):
    events = [meta(0), usage(1, 60, 60), usage(2, 100, 40)]
    home.write(events)
    for i in range(many):
        other = [meta(0), usage(1, 61 if conflict else 60, 60)]
        home.write(other, archived=True, stamp=f"12-00-{i:02d}")


def resumed(home, start=10):
    home.write([meta(0), usage(1, 100, 100), usage(5, 120, 20)])
    home.write([meta(start), usage(start, 30, 30)], suffix=f"_{OTHER}")


def overflow(home):
    home.write(
        [
            meta(0), usage(1, 100, 100, primary=50), usage(2, 200, 100, primary=100, balance=100.0), usage(3, 300, 100, primary=100, balance=95.0),
            usage(4, 400, 100, primary=100, balance=89.5), usage(5, 450, 50, primary=10),
        ]
    )


def parallel_balances(home):
    home.write([meta(0), usage(1, 10, 10, balance=100.0), usage(3, 20, 10, balance=95.0)])
    later = [usage(2, 10, 10, balance=100.0), usage(4, 20, 10, balance=95.0), usage(5, 30, 10, balance=1095.0), usage(6, 40, 10, balance=1090.0)]
    home.write([meta(0, CHILD), *later], thread=CHILD)


def write(*records, **kw):
    return lambda home: home.write(list(records), **kw)


def untimed():
    record = usage(1, 100, 100)
    del record["timestamp"]
    return record


# name: (files, period start offset, today (reliable, tokens, overflow, credits), period likewise; None = not reliable)
CASES = {
    "fork replay": (fork, DEFAULT_START, (150, 0, 0.0), (150, 0, 0.0)),
    "fork past its parent": (lambda h: fork(h, False), DEFAULT_START, None, None),
    "missing parent": (write(meta(2, CHILD, forked_from_id=PARENT), usage(3, 100, 100), thread=CHILD), DEFAULT_START, None, None),
    "resumed parent and child": (resumed_fork, DEFAULT_START, (180, 0, 0.0), (180, 0, 0.0)),
    "skipping fork": (skipping_fork, DEFAULT_START, (340, 0, 0.0), (340, 0, 0.0)),
    "archive copy": (copies, DEFAULT_START, (100, 0, 0.0), (100, 0, 0.0)),
    "many equal copies": (lambda h: copies(h, many=5), DEFAULT_START, (100, 0, 0.0), (100, 0, 0.0)),
    "conflicting copy": (lambda h: copies(h, conflict=True), DEFAULT_START, None, None),
    "resume": (resumed, DEFAULT_START, (150, 0, 0.0), (150, 0, 0.0)),
    "overlap": (lambda h: resumed(h, 5), DEFAULT_START, None, None),
    "foreign provider": (write(meta(0, provider="x"), usage(1, 100, 100)), DEFAULT_START, (0, 0, 0.0), None),
    "no provider": (write(meta(0, provider=None), usage(1, 100, 100)), DEFAULT_START, None, None),
    "no provider, no usage": (write(meta(0, provider=None)), DEFAULT_START, (0, 0, 0.0), None),
    "no root": (write(usage(1, 100, 100)), DEFAULT_START, None, None),
    "untimed": (write(meta(0), untimed()), DEFAULT_START, None, None),
    "cut token line": (write(meta(0), usage(1, 100, 100), '{"token_count"'.replace('{', '{"type": ')), DEFAULT_START, None, None),
    "cut context line": (write(meta(0), usage(1, 100, 100), '{"type": "turn_context"'), DEFAULT_START, (100, 0, 0.0), (100, 0, 0.0)),
    "overflow": (overflow, DEFAULT_START, (250, 200, 10.5), (250, 200, 10.5)),
    "capped from the start": (
        write(meta(0), usage(1, 100, 100, primary=100, balance=50.0), usage(2, 200, 100, primary=100, balance=30.0)),
        DEFAULT_START, (0, 200, 20.0), (0, 200, 20.0),
    ),
    "parallel balances": (parallel_balances, DEFAULT_START, (60, 0, 10.0), (60, 0, 10.0)),
    "balance without usage": (write(meta(0), usage(1, info=False, balance=50.0), usage(2, 100, 100, balance=45.0)), DEFAULT_START, (100, 0, 5.0), (100, 0, 5.0)),
    "small debits": (
        write(meta(0), *[usage(i, 10 * i, 10, balance=b) for i, b in enumerate((1.0, 0.996, 0.992), 1)]), DEFAULT_START, (30, 0, 0.008), (30, 0, 0.008),
    ),
    "debit across midnight": (
        write(meta(-DAY), usage(-DAY + 1, 10, 10, balance=100.0), usage(1, 20, 10, balance=90.0)), -DAY, (10, 0, 0.0), (20, 0, 10.0),
    ),
    "period start is inclusive": (write(meta(0), usage(0, 100, 100), usage(50, 125, 25), usage(60, 175, 50)), 50, (175, 0, 0.0), (75, 0, 0.0)),
    "no anchor": (write(meta(0), usage(1, 100, 100)), -3 * DAY, (100, 0, 0.0), None),
    "no period": (write(meta(0), usage(1, 100, 100)), None, (100, 0, 0.0), None),
    "counters beyond 64 bits": (
        write(meta(0), *[usage(i, None, {"input_tokens": 2**64 - 1, "output_tokens": i}) for i in (1, 2)]),
        DEFAULT_START, (2**64 - 1, 0, 0.0), (2**64 - 1, 0, 0.0),
    ),
    "old times late in the file": (write(meta(0), usage(10, 100, 100), usage(-DAY, 150, 50), usage(11, 180, 30)), DEFAULT_START, (130, 0, 0.0), (130, 0, 0.0)),
}
SPEEDS = [
    meta(0), model(1, "a", service_tier="default"), usage(2, None, {"input_tokens": 1000, "cached_input_tokens": 500, "output_tokens": 100}),
    settings(3, service_tier="priority"), usage(4, None, {"input_tokens": 300_000, "cached_input_tokens": 0, "output_tokens": 1000}),
]
PRICES = (
    ("a", "standard", True, (1.0, 0.1, 10.0), (2.0, 0.2, 20.0)),
    ("a", "fast", True, (2.0, 0.2, 20.0), (4.0, 0.4, 40.0)),
)


class NamedHome(Home):
    def __init__(self, root):
        self.root = root


@pytest.fixture(scope="module")
def report(spark):
    root = Path(tempfile.mkdtemp(prefix="tally-homes-"))
    starts = {}
    for i, (name, (build, start, *_)) in enumerate(CASES.items()):
        build(NamedHome(root / f"h{i:02d}"))
        starts[f"h{i:02d}"] = start
    NamedHome(root / "priced").write(SPEEDS)
    starts["priced"] = DEFAULT_START
    NamedHome(root / "unpriced").write([meta(0), model(1, "zz"), usage(2, 100, 100), usage(3, 200, {"total_tokens": 5})])
    starts["unpriced"] = DEFAULT_START
    logs = load_session_logs(spark, str(root), "UTC")
    base = int(BASE.timestamp())
    week = 604_800
    rows = [
        (f"file:{root}/{h}", nanos(600), (40.0, 300, base + 9_000), (50.0, 10_080, base + s + week) if s is not None else None, "plus")
        for h, s in starts.items()
    ]
    window = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
    snapshots = spark.createDataFrame(rows, f"home string, ts_nanos bigint, primary {window}, secondary {window}, plan_type string")
    prefix = logs.files.select("home").first().home.rsplit("/", 1)[0]
    snapshots = snapshots.withColumn("home", F.concat(F.lit(prefix + "/"), F.element_at(F.split("home", "/"), -1)))
    tables = usage_tables(logs.lines, logs.files, F.lit(nanos(700)), "UTC", 300, snapshots)
    prices = price_frame(spark, PRICES)
    found = {}
    for row in window_report(tables, prices).collect():
        found[row.home.rsplit("/", 1)[1], row.window_kind] = row
    texts = {r.home.rsplit("/", 1)[1]: r for r in usage_report(tables, prices, "UTC").collect()}
    issues = {(r.home.rsplit("/", 1)[1], r.issue_kind, r.issue) for r in report_issues(tables, prices).collect()}
    return found, texts, issues


@pytest.mark.parametrize("number", range(len(CASES)), ids=list(CASES))
def test_windows(report, number):
    found, _, _ = report
    *_, today, period = list(CASES.values())[number]
    for kind, expected in (("today", today), ("period", period)):
        row = found[f"h{number:02d}", kind]
        got = (row.tokens, row.overflow_tokens, round(row.credits_spent, 6)) if row.reliable else None
        assert got == expected, kind
        if not row.reliable:
            assert row.tokens is None and row.cost is None


def test_cost_and_texts(report):
    found, texts, issues = report
    row = found["priced", "period"]
    expected = (500 * 1 + 500 * 0.1 + 100 * 10 + 300_000 * 4 + 1000 * 40) / 1e6
    assert row.cost == pytest.approx(expected) and row.hit_tenths == 2
    text = texts["priced"]
    assert text.period_value_estimate == pytest.approx(expected * 2)
    assert text.period_token_estimate == 2 * 302_100
    assert (text.period_text, text.period_cost_text, text.period_label, text.plan_label) == ("30.2万 · 0.2%", "$1.24", "本周", "Plus")
    assert (text.headline, text.blocked, text.short_state) == (60.0, False, "ready")
    assert found["unpriced", "today"].cost is None
    # A bucket with details missing is a fault of the log, not of the prices.
    assert {i for i in issues if i[0] == "unpriced"} == {("unpriced", "gap", "model"), ("unpriced", "diagnostic", "details_missing")}
    # No usage costs nothing as long as there are prices.
    assert found["h10", "today"].cost == 0.0


def test_report_reads_stored_lines(spark, monkeypatch):
    """Lines and files are derived once; the report's branches read them back."""
    given = []
    monkeypatch.setattr(catalogue, "usage_tables", lambda lines, files, *rest: given.extend((lines, files)))
    catalogue._tables(spark, "/root/testdata/sf0.001")
    assert len(given) == 2
    assert all("get_json_object" not in t._jdf.queryExecution().optimizedPlan().toString() for t in given)
