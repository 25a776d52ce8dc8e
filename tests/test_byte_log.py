from __future__ import annotations

import io
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import byte_log
from tallyspark.sources.byte_log import canonical, discover, is_reachable, lines_of, read_lines, split_ranges
from tallyspark.sources.log_scan import load_session_logs, load_window_logs
from tests.logs import CHILD, PARENT, Home, meta, usage


class Bytes(io.BytesIO):
    """A file in memory that counts what is read."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.count = 0

    def read_at(self, n: int, at: int) -> bytes:
        self.seek(at)
        data = self.read(n)
        self.count += len(data)
        return data


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_any_cut_gives_every_line_once(monkeypatch, chunk):
    monkeypatch.setattr(byte_log, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(byte_log, "LOOK_BACK", 2)
    r = random.Random(chunk)
    for _ in range(60):
        text = b"".join(r.choice([b"", b"a", b"bc", b"\r", b"x" * 9]) + b"\n" for _ in range(r.randrange(8))) + r.choice([b"", b"open"])
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        edges = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(r.randrange(4)))})
        got = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in lines_of(Bytes(text), a, b)]
        assert got == want


def test_a_resumed_range_reads_its_own_bytes():
    text = b"x" * 1_000_000 + b"\n" + b"y" * 50
    file = Bytes(text + b"z\n")
    assert list(lines_of(file, len(text), len(text) + 2)) == [(1_000_001, b"y" * 50 + b"z")]
    # The open tail's head lies within one look back.
    assert file.count <= byte_log.LOOK_BACK + 60


def test_a_line_over_many_ranges_is_read_once():
    file = Bytes(b"a" * 5000 + b"\n")
    for begin in range(0, 5000, 100):
        assert list(lines_of(file, begin, begin + 100)) == []
    assert file.count == 5000
    assert [len(x) for _, x in lines_of(file, 5000, 5001)] == [5000]


def test_ranges_are_cut_and_lines_without_markers_stay(spark):
    ranges = spark.createDataFrame([("p", 5, 25), ("q", 3, 3)], byte_log.RANGES)
    assert sorted(map(tuple, split_ranges(ranges, 10).collect())) == [("p", 5, 15), ("p", 15, 25)]
    home = Home()
    path = home.write([meta(0), "secret prompt", usage(1, 5, 5), "größe", b"\xff broken"])
    size = path.stat().st_size
    rows = read_lines(spark.createDataFrame([(canonical(str(path)), 0, size), (canonical(str(path)) + "x", 0, 9)], byte_log.RANGES), 64).collect()
    lines = sorted(r.start for r in rows if r.range_end is None)
    assert len(lines) == 3 and not any("secret" in (r.value or "") for r in rows if r.value is not None and r.value.isascii())
    read = [r for r in rows if r.range_end is not None]
    assert sum(r.range_lines for r in read) == 5 and sum(r.range_bytes for r in read if r.range_error is None) == size
    assert [r.range_error for r in read if r.path.endswith("x")] == ["FileNotFoundError"]


def test_discovery_by_levels(spark):
    top = Home()
    deep = Home()
    deep.root = top.root / "a/.b/_c d/e%20f"
    deep.write([meta(0)])
    deep.write([meta(0, CHILD)], archived=True, thread=CHILD)
    deep.write([meta(0)], day="2026/08/.10")
    deep.write([meta(0)], day="x/2026/08/10")  # one level too deep
    (deep.root / "sessions" / "notes.txt").write_text("x")
    (top.root / "a" / "loop").symlink_to(top.root)
    (top.root / "sessions.jsonl").write_text("x")
    files, errors = discover(spark, str(top.root))
    found = {r.path.split(top.root.name)[1].rsplit("/", 1)[0]: r for r in files.collect()}
    assert set(found) == {"/a/.b/_c d/e%20f/sessions/2026/08/10", "/a/.b/_c d/e%20f/sessions/2026/08/.10", "/a/.b/_c d/e%20f/archived_sessions"}
    assert {r.home for r in found.values()} == {canonical(str(deep.root))} and errors.count() == 0
    only, _ = discover(spark, str(top.root), homes=[str(deep.root), str(top.root)])
    assert only.count() == 3
    inside, _ = discover(spark, str(deep.root / "sessions"))
    assert inside.count() == 2


def test_folders_that_cannot_be_listed(spark, monkeypatch):
    home = Home()
    with pytest.raises(OSError):
        discover(spark, str(home.root / "missing"))
    files, errors = discover(spark, str(home.root), homes=[str(home.root / "gone")])
    assert files.count() == 0 and [(r.home, r.errors) for r in errors.collect()] == [(canonical(str(home.root / "gone")), 1)]


def test_windows_read_what_they_need(spark):
    """By listing: files of the windows, and the parents of forks among them; others are not opened."""
    home, other = Home(), "b7405d2c-1e8f-4c6a-a0d3-58e2f9176c4b"
    grand = "0f3a9c52-6b1d-4e87-b2a4-7c5d8e9f1a06"
    fork = home.write([meta(0, CHILD, forked_from_id=PARENT), usage(1, 5, 5)], thread=CHILD, day="2026/08/10")
    parent = home.write([meta(0, forked_from_id=grand), usage(1, 7, 7)], day="2026/07/02")
    origin = home.write([meta(0, grand), usage(1, 9, 9)], thread=grand, day="2026/07/01")
    unused = home.write([meta(0, other), usage(1, 3, 3)], thread=other, day="2026/07/03")
    for old in (parent, origin, unused):
        os.utime(old, (1_780_000_000, 1_780_000_000))
    starts = spark.createDataFrame([(canonical(str(home.root)), "2026-08-08")], "home string, day string").select("home", F.col("day").cast("date").alias("period_start_date"))
    logs, counts = load_window_logs(spark, str(home.root), "UTC", F.lit("2026-08-10").cast("date"), starts)
    assert {r.path.rsplit("/", 1)[1] for r in logs.files.collect()} == {p.name for p in (fork, parent, origin)}
    row = counts.first()
    assert (row.files_listed, row.files_read, row.files_pruned) == (4, 3, 1)
    assert row.bytes_read == sum(p.stat().st_size for p in (fork, parent, origin))
    cold = load_session_logs(spark, str(home.root), "UTC")
    read = F.element_at(F.split("path", "/"), -1) != unused.name
    same = lambda df: sorted(str(r) for r in df.collect())
    assert same(logs.lines) == same(cold.lines.where(read)) and same(logs.files.select(*sorted(logs.files.columns))) == same(cold.files.where(read).select(*sorted(logs.files.columns)))


def test_places():
    assert canonical("/a b") == canonical("file:/a b") == canonical("file:///a b") == "file:///a b"
    assert canonical("s3a://bucket/x") == "s3a://bucket/x" and canonical("hdfs://n:1") == "hdfs://n:1/"
    assert is_reachable("/tmp") and not is_reachable("viewfs://c/x")
    assert byte_log.opened("file:///a/b")[1] == "/a/b"
    assert isinstance(byte_log.opened("file:///a")[0], pa.fs.LocalFileSystem)


def test_small_files_share_batches(tmp_path):
    import pyarrow as pa

    from tallyspark.sources.byte_log import CHUNK_ROWS, RANGES, _read_batches, canonical, write_text

    paths = [canonical(str(tmp_path / f"{i}.jsonl")) for i in range(500)]
    for i, path in enumerate(paths):
        write_text(path, b"".join(b'{"timestamp":"x","type":"event_msg","payload":{"type":"token_count","n":%d}}\n' % (i * 3 + j) for j in range(3)))
    given = pa.record_batch([pa.array(paths), pa.array([0] * 500), pa.array([1 << 20] * 500)], [f.split()[0] for f in RANGES.split(", ")])
    found = list(_read_batches(iter([given])))
    assert len(found) == 1 < CHUNK_ROWS and found[0].num_rows == 2_000
    rows = found[0].to_pylist()
    assert [r["path"] for r in rows if r["value"] is None] == paths and {r["range_lines"] for r in rows if r["value"] is None} == {3}
