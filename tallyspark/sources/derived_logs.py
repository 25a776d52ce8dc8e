"""A tree of session logs written from the driver tables, in two stages.

One file holds a user's lines of ten days. Between the stages files are
appended to (from an open last line on, for some), written anew, moved to the
archive, deleted and added, so that a resumed scan has all of it to follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.byte_log import canonical, opened, write_text
from tallyspark.sources.derived_inputs import log_text

# First match wins; the same text in both dialects.
CHANGE_RULE = (
    "case when user_id % 9 = 0 then 'deleted' when user_id % 10 = 1 then 'moved' when user_id % 7 = 3 then 'rewritten' "
    "when user_id % 6 = 5 then 'same' when user_id % 8 = 2 then 'new' else 'appended' end"
)
HOME_NAME = (
    "concat(case home % 4 when 0 then 'h' when 1 then '.h' when 2 then '_h x' else 'h%20' end, cast(home as varchar(20)))"
)
DAY_NANOS = 86_400_000_000_000


def logged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` (below the root), ``rule``, ``early`` and the text of every line."""
    lines = log_text(spark, sf_dir, cut_lines=False)
    lines = lines.withColumn("day", F.dayofmonth(F.timestamp_micros(F.expr("ts_nanos div 1000"))))
    lines = lines.withColumn("period", F.expr("(day - 1) div 10")).withColumn("rule", F.expr(CHANGE_RULE))
    name = F.format_string(
        "rollout-2024-01-%02dT00-00-00-%08x-0000-4000-8000-%012x.jsonl", F.col("period") * 10 + 1, F.col("user_id").cast("int"), "period"
    )
    return lines.select(
        F.expr(HOME_NAME).alias("home_name"), "user_id", "period", "rule", "line_no", "ts_nanos", "value",
        (((F.col("day") - 1) % 10) < 5).alias("early"),
        F.format_string("2024/01/%02d", F.col("period") * 10 + 1).alias("folder"), name.alias("name"),
    )


def user_of(path: Column) -> Column:
    return F.conv(F.regexp_extract(path, r"-([0-9a-f]{8})-0000-4000-8000-[0-9a-f]{12}\.jsonl$", 1), 16, 10).cast("bigint")


def period_of(path: Column) -> Column:
    return F.conv(F.regexp_extract(path, r"-0000-4000-8000-([0-9a-f]{12})\.jsonl$", 1), 16, 10).cast("bigint")


def write_stage(lines: DataFrame, root: str, stage: int) -> None:
    """Write the tree as of a stage, 1 or 2. Every file is written whole, so a task may run again."""
    top = canonical(root)

    def put(home: str, folder: str, name: str, rule: str, user: int, values: list[str], early: list[bool]) -> str:
        path = f"{top}/{home}/sessions/{folder}/{name}"
        first = [v for v, e in zip(values, early, strict=True) if e]
        text = None
        if stage == 1:
            if rule in ("deleted", "moved", "same"):
                text = "".join(v + "\n" for v in values)
            elif rule == "rewritten" and first:
                text = "".join(v + " \n" for v in first)
            elif rule == "appended" and first:
                text = "\n".join(first) + ("\n" if user % 2 else "")
        elif rule in ("rewritten", "new") or (rule == "appended" and (len(first) < len(values) or user % 2 == 0)):
            text = "".join(v + "\n" for v in values)
        elif rule in ("deleted", "moved"):
            store, place = opened(path)
            if rule == "moved":
                write_text(f"{top}/{home}/archived_sessions/{name}", "".join(v + "\n" for v in values).encode())
            if store.get_file_info(place).is_file:
                store.delete_file(place)
        if text is not None:
            write_text(path, text.encode())
        return path

    def put_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files one after the other: the rows of one are in a row."""
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in columns), strict=True))
        paths = []
        for key, group in groupby(rows, lambda row: row[:5]):
            values, early = zip(*(row[5:] for row in group), strict=True)
            paths.append(put(*key, list(values), list(early)))
            if len(paths) == 10_000:
                yield pa.record_batch([pa.array(paths)], ["path"])
                paths = []
        yield pa.record_batch([pa.array(paths, pa.string())], ["path"])

    file = ["home_name", "folder", "name"]
    columns = [*file, "rule", "user_id", "value", "early"]
    dealt = lines.repartition(*file).sortWithinPartitions(*file, "ts_nanos", "line_no").select(*columns)
    dealt.mapInArrow(put_files, "path string").write.format("noop").mode("overwrite").save()
