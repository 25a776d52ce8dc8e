"""Session logs as a stream source by bytes: ``spark.readStream.format("log_bytes")``.

An offset is the number of bytes of each log file that batches have covered. A
batch reads what lies between two offsets; a line belongs to the batch with its
newline, so one still being written waits. A file that became shorter is read
from its start again, in a new epoch.

The driver lists the tree for every batch and an offset names every file, so
this is for the trees that one process follows; for large ones the store of
``plans.refresh`` keeps the places as a table and lists on executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallyspark.sources.byte_log import SPLIT_BYTES, block_of, canonical, list_folder, read_ranges
from tallyspark.sources.session_logs import LOG_FOLDERS, LOG_PATH, parse_text

SCHEMA = "path string, epoch int, start bigint, value binary"


@dataclass
class ByteRange(InputPartition):
    path: str
    epoch: int
    begin: int
    end: int


def walk(root: str) -> dict[str, int]:
    """Length of every log file below a root."""
    waiting: list[tuple[str, int | None]] = [(root, 3 if root.endswith("/" + LOG_FOLDERS[0]) else None)]
    found: dict[str, int] = {}
    while waiting:
        path, depth = waiting.pop()
        for kind, child, level, length, _, reason in list_folder(path, depth, True):
            if kind == "file":
                found[child] = length
            elif kind == "folder":
                waiting.append((child, level))
            elif path == root:
                raise OSError(f"cannot list {path}: {reason}")
    return found


class LogBytesStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = canonical(options["path"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        now = {}
        for path, length in walk(self.root).items():
            epoch, before = self.known.get(path, (0, 0))
            now[path] = [epoch + (length < before), length]
        self.known = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for path, (epoch, length) in sorted(end["files"].items()):
            before_epoch, before = start["files"].get(path, (epoch, 0))
            begin = before if before_epoch == epoch and before <= length else 0
            out += [ByteRange(path, epoch, at, min(at + self.split, length)) for at in range(begin, length, self.split)]
        for path, place in end["files"].items():
            self.known.setdefault(path, place)
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for batch in read_ranges([(partition.path, partition.begin, partition.end)]):
            lines = batch.filter(pa.compute.is_valid(batch["start"]))
            epoch = pa.array([partition.epoch] * lines.num_rows, pa.int32())
            yield pa.record_batch([lines["path"], epoch, lines["start"], lines["value"]], ["path", "epoch", "start", "value"])


class LogBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_bytes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogBytesStream:
        return LogBytesStream(self.options)


def stream_log_lines(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Parsed usage lines of a growing tree, numbered by their first byte like a cold scan's."""
    spark.dataSource.register(LogBytes)
    raw = spark.readStream.format("log_bytes").option("splitbytes", split_bytes).load(root)
    parsed = parse_text(raw.withColumn("value", F.col("value").cast("string"))).where("is_marked AND NOT is_broken")
    is_token = (F.col("kind") == "token") & (F.col("total").isNotNull() | F.col("last").isNotNull())
    return parsed.select(
        F.regexp_extract("path", LOG_PATH, 1).alias("home"), "path", "epoch", F.col("start").alias("line_no"), block_of(F.col("start")).alias("block"),
        *[c for c in parsed.columns if c not in ("path", "epoch", "start", "n_bytes", "is_empty")], F.coalesce(is_token, F.lit(False)).alias("is_token"),
    )
