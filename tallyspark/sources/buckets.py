"""Tables in hash buckets, written copy-on-write, with a log of generations.

A write replaces only the buckets it names, as a new generation; a small log
entry names the live generation of every bucket of every table. Readers of an
older entry keep their files until these have aged. An entry counts once it has
its name, so a run that dies before leaves the older one in force.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generations that no reader of a younger log entry needs are kept so long.
KEEP_SECONDS = 24 * 3600


@dataclass
class Entry:
    """One log entry: the live generation of each bucket, for every table."""

    number: int
    written: float
    buckets: int
    live: dict[str, dict[int, int]]

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "written": self.written, "buckets": self.buckets, "live": self.live})

    @staticmethod
    def of_json(text: str) -> Entry:
        raw = json.loads(text)
        live = {t: {int(b): g for b, g in m.items()} for t, m in raw["live"].items()}
        return Entry(raw["number"], raw["written"], raw["buckets"], live)

    def parts(self) -> set[tuple[str, int, int]]:
        return {(t, g, b) for t, m in self.live.items() for b, g in m.items()}


class Buckets:
    """Tables below one folder, bucketed alike by ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, tables: Sequence[str], keys: Sequence[str], buckets: int):
        self.spark, self.folder, self.tables, self.keys, self.buckets = spark, folder, tuple(tables), tuple(keys), buckets
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def numbers_of(self, rows: DataFrame) -> set[int]:
        """The buckets that hold these keys; at most as many as there are."""
        return {r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}

    def _names(self, folder: str) -> list[str]:
        path = self.Path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/log") if n.isdigit())

    def entries(self) -> list[Entry]:
        """Log entries, oldest first."""
        return [self._entry(n) for n in self._numbers()]

    def newest(self, before: int | None = None) -> Entry | None:
        """The newest entry, or the newest one of a generation before that."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        return self._entry(numbers[-1]) if numbers else None

    def _entry(self, number: int) -> Entry:
        entry = Entry.of_json(self.spark.read.text(f"{self.folder}/log/{number}").first()["value"])
        if entry.buckets != self.buckets:
            raise ValueError(f"the tables have {entry.buckets} buckets, not {self.buckets}")
        return entry

    def read(self, entry: Entry | None, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        """The table as an entry saw it, or some of its buckets; none if it has no rows there.

        Paths are at most as many as there are buckets.
        """
        live = {} if entry is None else entry.live.get(table, {})
        paths = [f"{self.folder}/{table}/g={g}/bucket={b}" for b, g in sorted(live.items()) if buckets is None or b in buckets]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths).drop("g", "bucket")

    def write(self, table: str, generation: int, df: DataFrame) -> None:
        """One table's changed buckets; a large bucket is written by many tasks."""
        out = df.withColumn("bucket", self.bucket())
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/g={generation}")

    def written(self, table: str, generation: int, like: DataFrame) -> DataFrame:
        """What ``write`` has just written."""
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{table}/g={generation}").select(*like.columns)

    def held(self, table: str, generation: int) -> set[int]:
        return {int(n.split("=")[1]) for n in self._names(f"{self.folder}/{table}/g={generation}") if n.startswith("bucket=")}

    def commit(self, entry: Entry | None, generation: int, changed: set[int] | dict[str, set[int]]) -> Entry:
        """The entry after ``changed`` buckets, of all tables or of those named, were written as ``generation``."""
        live = {}
        for table in self.tables:
            old = {} if entry is None else entry.live.get(table, {})
            gone = changed.get(table) if isinstance(changed, dict) else changed
            if gone is None:
                live[table] = old
                continue
            live[table] = {b: g for b, g in old.items() if b not in gone} | dict.fromkeys(self.held(table, generation), generation)
        new = Entry(generation, time.time(), self.buckets, live)
        part, name = (self.Path(f"{self.folder}/log/{generation}{end}") for end in (".part", ""))
        self.spark.createDataFrame([(new.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(part.toString())
        self.fs.delete(name, True)  # of a run of the same generation that was repeated
        self.fs.rename(part, name)
        return new

    def forget(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Delete entries older than ``keep_seconds`` but for the newest, and what only they refer to."""
        entries = self.entries()
        old = [e for e in entries[:-1] if e.written < time.time() - keep_seconds]
        if not old:
            return 0
        used = set().union(*(e.parts() for e in entries if e not in old))
        gone = set().union(*(e.parts() for e in old)) - used
        for table, generation, bucket in sorted(gone):
            self.fs.delete(self.Path(f"{self.folder}/{table}/g={generation}/bucket={bucket}"), True)
        for e in old:
            self.fs.delete(self.Path(f"{self.folder}/log/{e.number}"), True)
        return len(gone)
