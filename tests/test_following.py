"""Streams that go on from carried values and from bytes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyspark.operators.timeline import token_events
from tallyspark.session import settle
from tallyspark.sources.event_feed import event_lines
from tallyspark.sources.log_scan import load_session_logs
from tallyspark.streaming import parse_table
from tallyspark.streaming.log_source import stream_log_lines, walk
from tallyspark.streaming.parse_table import events_of, parse_batch, parse_lines
from tests.logs import CHILD, Home, meta, model, usage

SF = "/root/testdata/sf0.001"
COLUMNS = [
    "home", "path", "line_no", "model", "tier_kind", "tier_text", "is_duplicate", "is_stale", "overflow",
    "delta_total", "delta_uncached", "delta_cached", "delta_output",
]


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*[F.col(c).cast("string") for c in COLUMNS]).collect())


def test_carried_values_stand_for_all_earlier_lines(spark):
    """Batches of few lines, in blocks of few rows, some delivered twice: the events of one scan."""
    lines = settle(event_lines(spark, SF, variants=True, block_rows=40))
    cuts = [-1, 150, 420, 700, 2**62]
    carry = peaks = None
    found = []
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        again = low - 60 if number == 2 else low
        batch = settle(lines.where((F.col("line_no") > again) & (F.col("line_no") <= high)))
        events, new_carry, new_peaks = parse_batch(batch, carry, peaks)
        found += rows(events)
        carry, peaks = settle(new_carry), settle(new_peaks)
    assert sorted(found) == rows(token_events(lines))
    assert carry.count() == lines.select("home", "path").distinct().count()


def test_stream_by_bytes_into_carried_values(spark, tmp_path):
    """Appended, open and new files followed by bytes: lines and events of a cold scan, state files bounded, no Python on the parse side."""
    home = Home()
    root, folder = str(home.root), str(tmp_path / "out")
    columns = [*COLUMNS, "epoch"]

    def follow():
        stream = stream_log_lines(spark, root, split_bytes=300)
        parse_lines(stream, columns, folder).trigger(availableNow=True).start().awaitTermination()

    path = home.write([meta(0), model(0, "a"), usage(1, 100, 100)], tail=json.dumps(usage(2, 150, 50))[:30])
    follow()
    with path.open("ab") as f:
        f.write(json.dumps(usage(2, 150, 50))[30:].encode() + b"\n")
    home.write([meta(0, CHILD), usage(1, 5, 5), usage(2, 5, 5)], thread=CHILD)
    follow()
    with path.open("ab") as f:
        f.write("".join(json.dumps(x) + "\n" for x in (usage(3, 150, 50), model(4, "b"), usage(5, 150, 50), usage(6, 400))).encode())
    follow()
    cold = load_session_logs(spark, root, "UTC")
    got = events_of(spark, folder)
    assert rows(got) == rows(token_events(cold.lines)) and got.select("batch").distinct().count() == 3
    assert set(walk("file://" + root).values()) == {p.stat().st_size for p in home.root.rglob("*.jsonl")}


def test_batches_in_order_are_stored_once_and_narrow(spark, tmp_path, monkeypatch):
    """Lines that come in order are written once a batch, without what neither parsing nor the wanted columns read."""
    stored = []
    monkeypatch.setattr(parse_table, "settle", lambda df: stored.append(df.columns) or settle(df))
    lines = settle(event_lines(spark, SF))
    incoming = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in/*")
    columns = ["home", "path", "line_no", "delta_total"]
    for number, (low, high) in enumerate([(-1, 500), (500, 2**62)]):
        lines.where((F.col("line_no") > low) & (F.col("line_no") <= high)).write.parquet(f"{tmp_path}/in/{number}")
        parse_lines(incoming, columns, f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sum("total" in c for c in stored) == 2
    assert not {"limits", "balance", "ts_nanos", "user_id"} & {c for some in stored for c in some}
    found = events_of(spark, f"{tmp_path}/out").select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, token_events(lines).select(*columns).collect()))
