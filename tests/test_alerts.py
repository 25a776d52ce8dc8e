"""Alert rules: one table of looks, a home for each case."""

from __future__ import annotations

import pytest

from tallyspark.operators.watching import alerts_in, find_alerts, judge_looks, state_after
from tallyspark.session import settle
from tallyspark.streaming.alerts import AlertRules, alerts_of, watch

SECOND = 1_000_000_000
NOON = 1_800_000_000
HOUR, WEEK = 18_000, 604_800
SCHEMA = (
    "home string, observed_nanos bigint, received bigint, account string, `limit` string, primary_used double, primary_seconds bigint,"
    "primary_resets_at bigint, secondary_used double, secondary_seconds bigint, secondary_resets_at bigint, overflow_credits double"
)
SHORT, LONG = (20.0, NOON + 9_000), (60.0, NOON + 400_000)


def look(after=0, short=SHORT, long=LONG, account="ann", limit="usage", credits=None, seen=None, lengths=(HOUR, WEEK)):
    """A reading ``after`` seconds, looked at then or ``seen`` seconds after noon."""
    observed = NOON + (after if seen is None else seen)
    second = (long[0], lengths[1], long[1]) if long else (None, None, None)
    return (observed * SECOND, (NOON + after) * SECOND, account, limit, short[0], lengths[0], short[1], *second, credits)


def nothing(seen):
    return ((NOON + seen) * SECOND, *[None] * 9, None)


BACK = {"short": (0.5, NOON + 12_000), "long": (0.0, NOON + 600_000)}
NEXT = (1.0, SHORT[1] + HOUR)
LATER = (1.0, LONG[1] + WEEK)
CASES = {
    "given back": ([look(), look(600, **BACK)], [("reset", HOUR, 99.5), ("reset", WEEK, 100.0)]),
    "replaced": ([look(), look(300, short=NEXT)], [("reset", HOUR, 99.0)]),
    "replaced, drift allowed": ([look(), look(300, short=(30.0, NEXT[1] + 1_800))], [("reset", HOUR, 70.0)]),
    "replaced, drift too far": ([look(), look(300, short=(30.0, NEXT[1] + 1_801))], []),
    "account unknown, still replaced": ([look(), look(300, short=NEXT, account=None)], [("reset", HOUR, 99.0)]),
    "another account": ([look(), look(600, account="bob", **BACK)], []),
    "another account, replaced": ([look(), look(300, short=NEXT, account="bob")], []),
    "account unknown": ([look(), look(600, account=None, **BACK)], []),
    "another limit": ([look(), look(600, limit="x", **BACK)], []),
    "no later reading": ([look(), look(0, seen=60, **BACK)], []),
    "gap": ([look(), look(901, **BACK)], []),
    "small drop": ([look(short=(5.0, SHORT[1]), long=(4.9, LONG[1])), look(600, **BACK)], []),
    "too much used": ([look(), look(600, short=(1.5, NOON + 12_000), long=(30.0, NOON + 600_000))], []),
    "reset earlier": ([look(), look(600, short=(0.0, NOON + 8_900), long=(0.0, NOON + 399_000))], []),
    "other lengths": ([look(), look(600, lengths=(3_600, 86_400), **BACK)], []),
    "over already": ([look(), look(600, short=(0.0, NOON + 500))], []),
    "used up still": ([look(), look(600, short=BACK["short"], long=(100.0, LONG[1]))], []),
    "old record late": (
        [look(), look(300, short=NEXT, account=None), look(400, account=None), look(500, short=(2.0, NEXT[1]), account=None)],
        [("reset", HOUR, 99.0)],
    ),
    "looked at too late": ([look(), look(300, short=NEXT, seen=1_300)], []),
    "only a long window": ([look(long=None, lengths=(WEEK, 0)), look(300, short=(0.0, SHORT[1] + WEEK), long=None, lengths=(WEEK, 0))], [("reset", WEEK, 100.0)]),
    "windows the other way round": ([look(lengths=(WEEK, HOUR)), look(300, short=(0.0, SHORT[1] + WEEK), lengths=(WEEK, HOUR))], [("reset", WEEK, 100.0)]),
    "credits begin": ([look(0, credits=0.0), look(60, credits=0.24), look(120, credits=0.25), look(180, credits=5.0)], [("overflow", WEEK, 0.25)]),
    "credits, start unseen": ([look(0, credits=3.0), look(60, credits=4.0)], []),
    "credits unknown between": ([look(0, credits=0.0), look(60), look(120, credits=1.0)], [("overflow", WEEK, 1.0)]),
    "credits over a gap": ([look(0, credits=0.0), look(1_000, credits=1.0)], []),
    "credits, seen again after a gap": ([look(0, credits=0.0), look(1_000, credits=0.1), look(1_060, credits=1.0)], [("overflow", WEEK, 1.0)]),
    "credits, new period": (
        [look(0, credits=0.0), look(60, credits=1.0, long=LATER, account=None), look(120, credits=0.0, long=LATER), look(180, credits=1.0, long=LATER)],
        [("reset", WEEK, 99.0), ("overflow", WEEK, 1.0)],
    ),
    "credits, no long window": ([look(0, credits=0.0, long=None), look(60, credits=1.0, long=None)], []),
    "credits, stale reading": ([look(0, credits=0.0), look(0, credits=0.0, seen=901), look(960, credits=1.0)], []),
    "credits, nothing seen between": ([look(0, credits=0.0), nothing(60), look(120, credits=1.0)], []),
}


def rows_of(cases):
    return [(name, *row) for name, (looks, _) in cases.items() for row in looks]


@pytest.fixture(scope="module")
def alerts(spark):
    found = find_alerts(spark.createDataFrame(rows_of(CASES), SCHEMA), 300)
    out = {name: [] for name in CASES}
    for r in found.orderBy("observed_nanos", "seconds").collect():
        out[r["home"]].append((r["kind"], r["seconds"], r["value"]))
    return out


@pytest.mark.parametrize("name", CASES)
def test_rules(alerts, name):
    assert sorted(alerts[name]) == sorted(CASES[name][1])


def test_stream_equals_history_and_survives_restarts(spark, tmp_path):
    frame = spark.createDataFrame(rows_of(CASES), SCHEMA)
    cut = [NOON + s for s in (200, 500)]
    parts = [f"observed_nanos < {cut[0]}000000000", f"observed_nanos between {cut[0]}000000000 and {cut[1]}999999999", f"observed_nanos > {cut[1]}999999999"]
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    for number, part in enumerate(parts):
        frame.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        # Credits are switched off at first: what they would have said is used up.
        rules = AlertRules(300, overflow=number > 0)
        watch(source, rules, f"{tmp_path}/watch").trigger(availableNow=True).start().awaitTermination()
    columns = ["home", "observed_nanos", "kind", "seconds", "value"]
    got = sorted(tuple(r) for r in alerts_of(spark, f"{tmp_path}/watch").select(*columns).collect())
    want = sorted(tuple(r) for r in find_alerts(frame, 300).select(*columns).collect() if r["kind"] == "reset" or r["observed_nanos"] >= cut[0] * SECOND)
    assert got == want


def test_state_stands_for_all_earlier_looks(spark):
    """Looks in many batches, with state carried: the same alerts as at once."""
    frame = spark.createDataFrame(rows_of(CASES), SCHEMA)
    times = sorted({r.observed_nanos for r in frame.select("observed_nanos").collect()})
    found, state, fired = [], None, None
    for a, b in zip([0, *times[4::8]], [*times[4::8], times[-1] + 1], strict=True):
        rows = settle(judge_looks(frame.where(f"observed_nanos >= {a} AND observed_nanos < {b}"), 300, state))
        new, spent = alerts_in(rows, 300, fired=fired)
        found += [tuple(r) for r in new.collect()]
        after = state_after(rows)
        state = settle(after if state is None else after.unionByName(state.join(after, "home", "left_anti")))
        fired = settle(spent if fired is None else spent.unionByName(fired))
    assert state.count() == state.select("home").distinct().count()
    assert sorted(found) == sorted(tuple(r) for r in find_alerts(frame, 300).collect())


def test_month_windows_and_state_files(spark, tmp_path):
    """A look of more than a month ago still counts, and state files do not pile up."""
    month = 44_640 * 60
    old = look(0, short=(80.0, NOON + 100), long=(90.0, NOON + month), lengths=(HOUR, month), credits=0.0)
    late = month - 600
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    rows = [
        [("h", *old)],
        [("o", *look(60))],
        [("h", *look(late, short=(5.0, NOON + late + 900), long=(95.0, NOON + month), lengths=(HOUR, month)))],
        [("h", *look(late + 700, short=(5.0, NOON + late + 900), long=(1.0, NOON + 2 * month), lengths=(HOUR, month)))],
    ]
    rules = AlertRules(300, buckets=2, keep_seconds=0)
    for number, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        watch(source, rules, f"{tmp_path}/watch").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in alerts_of(spark, f"{tmp_path}/watch").select("home", "kind", "seconds", "value").collect()]
    assert got == [("h", "reset", month, 99.0)]
    folders = list((tmp_path / "watch" / "state" / "state").glob("g=*/bucket=*"))
    assert len(folders) <= 3 and len(list((tmp_path / "watch" / "state" / "log").iterdir())) == 1
