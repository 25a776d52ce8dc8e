"""Session logs by bytes: discovery on executors and reads that resume.

Discovery expands a frontier of folders, one level a round, as a table; no
folder is listed by the driver, and names that begin with a dot or underscore
are names like any other. A folder that cannot be listed is a row of its own.

A read is a table of byte ranges. A line belongs to the range that holds its
newline: ranges can be cut and resumed anywhere, a line still being written
waits for the range with its end, and a file that grew costs what was
appended. Lines are numbered by their first byte, so a resumed read numbers
them as a cold one does, and ``block`` is the stretch of ``BLOCK_BYTES`` in
which a line starts.

Lines without a usage marker do not leave the reader, unless they are no valid
UTF-8 and thus count as unreadable. Stores are reached through ``pyarrow.fs``
(local paths, ``hdfs``, ``s3``, ``gs``, ``abfs``), since no reader of Spark
reads from a byte on or opens hidden files.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyspark
from tallyspark.fixed_values import LINE_MARKERS
from tallyspark.session import settle
from tallyspark.sources.session_logs import LOG_FOLDERS, LOG_PATH, date_folder_of, thread_id_of

# Ship the readers with the plan: workers need no copy of the package.
cloudpickle.register_pickle_by_value(tallyspark)

SPLIT_BYTES = 64 << 20  #: a range of a larger file is cut into such pieces
BLOCK_BYTES = 32 << 20  #: lines that start in one such stretch are one block
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 10_000
LOOK_BACK = 64 << 10
TAIL_BYTES = 256  #: bytes before the resume point that must not have changed

FOUND = "kind string, path string, depth int, length bigint, millis bigint, reason string"
RANGES = "path string, from_byte bigint, to_byte bigint"
READ = "path string, start bigint, value binary, range_end bigint, range_lines bigint, range_bytes bigint, range_tail string, range_error string"
READ_NAMES = ["path", "start", "value", "range_end", "range_lines", "range_bytes", "range_tail", "range_error"]
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_MARKERS = tuple(m.encode() for m in LINE_MARKERS)


def canonical(path: str) -> str:
    """``scheme://authority/path``; plain and ``file:`` paths are local ones."""
    if (m := re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)?$", path)) is not None:
        return f"{m[1]}://{m[2]}{m[3] or '/'}"
    return "file://" + os.path.abspath(path.removeprefix("file:"))


@lru_cache(maxsize=64)
def _store(prefix: str) -> tuple[pafs.FileSystem, str]:
    scheme, authority = prefix.split("://")
    if scheme == "file":
        return pafs.LocalFileSystem(), ""
    store, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")
    return store, base.rstrip("/")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a canonical path, and the path in it."""
    at = path.index("/", path.index("://") + 3)
    store, base = _store(path[:at])
    return store, base + path[at:]


def is_reachable(path: str) -> bool:
    """Whether ``pyarrow.fs`` knows the store; otherwise only Spark's own readers do."""
    try:
        opened(canonical(path))
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


# --- discovery ---------------------------------------------------------------


def list_folder(path: str, depth: int | None, walk: bool) -> Iterator[tuple]:
    """Rows of ``FOUND`` for one folder.

    ``depth``: levels of log folder that may follow, null outside of one;
    ``walk``: whether folders outside of log folders are walked.
    """
    store, place = opened(path)
    try:
        entries = store.get_file_info(pafs.FileSelector(place, allow_not_found=False))
    except (OSError, pa.ArrowException) as problem:
        yield "failed", path, depth, None, None, type(problem).__name__
        return
    for entry in entries:
        child = f"{path.rstrip('/')}/{entry.base_name}"
        if entry.type == pafs.FileType.File:
            if depth is not None and entry.base_name.endswith(".jsonl"):
                yield "file", child, depth, entry.size, (entry.mtime_ns or 0) // 1_000_000, None
        elif entry.type == pafs.FileType.Directory:
            if isinstance(store, pafs.LocalFileSystem) and os.path.islink(entry.path):
                continue  # a link may lead back to where it stands
            if entry.base_name in LOG_FOLDERS and depth is None:
                yield "folder", child, 3 if entry.base_name == LOG_FOLDERS[0] else 0, None, None, None
            elif depth is None and walk:
                yield "folder", child, None, None, None, None
            elif depth:
                yield "folder", child, depth - 1, None, None, None


def _list_level(batches: Iterator[pa.RecordBatch], walk: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["kind", "path", "depth", "length", "millis", "reason"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows: list[tuple] = []
    for given in batches:
        for path, depth in zip(given["path"].to_pylist(), given["depth"].to_pylist(), strict=True):
            for row in list_folder(path, depth, walk):
                rows.append(row)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def discover(spark: SparkSession, root: str, homes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (``home, path, length, modified_at, readable``, name parts) and ``home, errors`` of folders not listed.

    Every level of folders is one table. ``homes``: only their log folders are
    looked at, and no tree is walked to find them. A root that cannot be listed
    is an error: nothing is known then.
    """
    top = canonical(root)
    places = [(canonical(h), None) for h in homes] if homes is not None else [(top, None)]
    if homes is None and top.rsplit("/", 1)[1] in LOG_FOLDERS:
        places.append((top, 3 if top.endswith("/" + LOG_FOLDERS[0]) else 0))
    frontier = spark.createDataFrame(places, "path string, depth int")
    walk = homes is None
    levels = []
    while True:
        # By number: adaptive execution would put so few bytes in one task, which then lists every folder.
        spread = frontier.repartition(spark.sparkContext.defaultParallelism, "path") if levels else frontier
        level = settle(spread.mapInArrow(lambda b: _list_level(b, walk), FOUND))
        if not levels and walk and (lost := level.where("kind = 'failed'").first()) is not None:
            raise OSError(f"cannot list {lost['path']}: {lost['reason']}")
        levels.append(level)
        frontier = level.where("kind = 'folder'").select("path", "depth")
        if frontier.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    files = found.where("kind = 'file'").select("path", "length", F.timestamp_millis("millis").alias("modified_at")).distinct()
    files = files.where(F.col("path").rlike(LOG_PATH)).select(
        F.regexp_extract("path", LOG_PATH, 1).alias("home"),
        "path",
        "length",
        "modified_at",
        F.lit(True).alias("readable"),
        thread_id_of(F.col("path")).alias("filename_thread_id"),
        date_folder_of(F.col("path")).alias("partition_date"),
    )
    # A folder outside a log folder stands for a home of its own, so that what lies below has a row that says so.
    inside = F.regexp_extract("path", rf"^(.*?)/(?:{'|'.join(LOG_FOLDERS)})(?:/.*)?$", 1)
    home = F.when(F.col("depth").isNotNull() & (inside != ""), inside).otherwise(F.col("path"))
    failed = found.where("kind = 'failed'").select("path", "depth").distinct()
    return files, failed.groupBy(home.alias("home")).agg(F.count(F.lit(1)).alias("errors"))


# --- reading -----------------------------------------------------------------


def line_start(file: pa.NativeFile, at: int) -> int:
    """The first byte of the line that holds byte ``at``, or would begin there."""
    end = at
    while end > 0:
        begin = max(0, end - LOOK_BACK)
        found = file.read_at(end - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def lines_of(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """First byte and text of every line whose newline lies in [begin, end)."""
    at, start, held = begin, begin, []
    known = begin == 0  # whether the line that runs into the range is at hand
    while at < end:
        chunk = file.read_at(min(CHUNK_BYTES, end - at), at)
        if not chunk:
            return  # the file became shorter
        at += len(chunk)
        if b"\n" not in chunk:
            held.append(chunk)
            continue
        parts = (b"".join(held) + chunk).split(b"\n")
        held = [parts.pop()]
        if not known:
            start = line_start(file, begin)
            parts[0] = file.read_at(begin - start, start) + parts[0]
            known = True
        for text in parts:
            yield start, text
            start += len(text) + 1


def tail_digest(file: pa.NativeFile, end: int) -> str:
    """Digest of the bytes before ``end``."""
    begin = max(0, end - TAIL_BYTES)
    return hashlib.md5(file.read_at(end - begin, begin), usedforsecurity=False).hexdigest()


def is_wanted(text: bytes) -> bool:
    if any(m in text for m in _MARKERS):
        return True
    if text.isascii():
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return True
    return False


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return read_ranges((row["path"], row["from_byte"], row["to_byte"]) for given in batches for row in given.to_pylist())


def read_ranges(ranges: Iterable[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of many small ranges share a batch; a batch has about ``CHUNK_BYTES`` of text."""
    rows: list[tuple] = []
    size = 0
    for path, begin, end in ranges:
        for found in read_range(path, begin, end):
            rows.append(found)
            size += len(found[2] or b"")
            if size > CHUNK_BYTES or len(rows) == CHUNK_ROWS:
                yield _row_batch(rows)
                rows, size = [], 0
    if rows:
        yield _row_batch(rows)


def read_range(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Rows of ``READ``: the wanted lines, and one row about the range itself."""
    lines = 0
    tail = error = None
    try:
        store, place = opened(path)
        with store.open_input_file(place) as file:
            end = min(end, file.size())
            for start, text in lines_of(file, begin, end):
                lines += 1
                if is_wanted(text):
                    yield path, start, text, None, None, None, None, None
            tail = tail_digest(file, end)
    except (OSError, pa.ArrowException) as problem:
        error = type(problem).__name__
    yield path, None, None, end, lines, max(0, end - begin), tail, error


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], READ_NAMES)


def split_ranges(ranges: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ranges of more than ``split_bytes`` in pieces; empty ones go."""
    piece = F.explode(F.sequence(F.col("from_byte"), F.col("to_byte") - 1, F.lit(split_bytes).cast("bigint")))
    cut = ranges.where("to_byte > from_byte").select("path", "to_byte", piece.alias("from_byte"))
    return cut.select("path", "from_byte", F.least("to_byte", F.col("from_byte") + split_bytes).alias("to_byte"))


def read_lines(ranges: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The wanted lines of byte ranges (``path, from_byte, to_byte``) and a row for each range, as ``READ`` says.

    ``value`` is text as it stands in the file. Pieces are dealt by place, as
    many tasks as there are ``split_bytes`` to read.
    """
    ranges = settle(split_ranges(ranges, split_bytes))
    total = ranges.agg(F.sum(F.col("to_byte") - F.col("from_byte"))).first()[0] or 0
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-total // split_bytes))
    raw = ranges.repartition(tasks, "path", "from_byte").mapInArrow(_read_batches, READ)
    return raw.withColumn("value", F.col("value").cast("string"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        same = []
        for row in given.to_pylist():
            try:
                store, place = opened(row["path"])
                with store.open_input_file(place) as file:
                    same.append(file.size() >= row["consumed"] and tail_digest(file, row["consumed"]) == row["tail"])
            except (OSError, pa.ArrowException):
                same.append(False)
        yield pa.record_batch([given["path"], pa.array(same, pa.bool_())], ["path", "same_tail"])


def probe_tails(places: DataFrame) -> DataFrame:
    """``path, same_tail``: whether a file still ends a stored read where it did (``path, consumed, tail``)."""
    tasks = places.sparkSession.sparkContext.defaultParallelism
    return places.select("path", "consumed", "tail").repartition(tasks, "path").mapInArrow(_probe, "path string, same_tail boolean")


# --- writing -----------------------------------------------------------------


def write_text(path: str, text: bytes, append: bool = False) -> int:
    """Write or lengthen a file; returns its length."""
    store, place = opened(canonical(path))
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_append_stream(place) if append else store.open_output_stream(place) as file:
        file.write(text)
    return store.get_file_info(place).size


def block_of(start: Column) -> Column:
    return F.shiftright(start, BLOCK_BYTES.bit_length() - 1)
