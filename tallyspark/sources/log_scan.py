"""A cold scan of session logs, and what a scan and a resumed read share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.carry import FILE
from tallyspark.operators.windows import local_date
from tallyspark.session import settle
from tallyspark.sources.byte_log import SPLIT_BYTES, block_of, discover, is_reachable, read_lines
from tallyspark.sources.session_logs import LOG_PATH, SessionLogs, file_table, load_with_readers, parse_text


def read_index(ranges: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Parsed lines and range rows of ``ranges``, in one pass over the text, which is not stored."""
    return settle(parse_text(read_lines(ranges, split_bytes)))


def lines_of_index(index: DataFrame) -> DataFrame:
    """The lines that count or are broken, numbered by their first byte."""
    is_token = (F.col("kind") == "token") & (F.col("total").isNotNull() | F.col("last").isNotNull())
    return index.where("range_end IS NULL").select(
        F.regexp_extract("path", LOG_PATH, 1).alias("home"),
        "path",
        F.col("start").alias("line_no"),
        block_of(F.col("start")).alias("block"),
        *[c for c in index.columns if not c.startswith("range_") and c not in ("path", "start", "n_bytes", "is_empty")],
        F.coalesce(is_token, F.lit(False)).alias("is_token"),
    )


def ranges_of_index(index: DataFrame) -> DataFrame:
    """Per file that was read: ``path, failed, lines_read, bytes_read, consumed, tail``."""
    return index.where("range_end IS NOT NULL").groupBy("path").agg(
        F.bool_or(F.col("range_error").isNotNull()).alias("failed"),
        F.sum("range_lines").alias("lines_read"),
        F.sum("range_bytes").alias("bytes_read"),
        F.max("range_end").alias("consumed"),
        F.max_by("range_tail", "range_end").alias("tail"),
    )


def logs_of(lines: DataFrame, listed: DataFrame, tz: str, discovery: DataFrame | None = None) -> SessionLogs:
    """``lines``: also broken ones. ``listed``: files with ``unread``."""
    return SessionLogs(lines.where("is_marked AND NOT is_broken"), file_table(lines, listed, tz), discovery)


def load_session_logs(spark: SparkSession, root: str, tz: str, homes: list[str] | None = None) -> SessionLogs:
    """Parse every log below ``root`` (or of the given homes) into lines and a file table.

    Hidden folders and files are read like others. In a store that only
    Spark's readers know, hidden files stay unread and say so.
    """
    if not is_reachable(root):
        return load_with_readers(spark, root, tz, homes)
    files, errors = discover(spark, root, homes)
    files = settle(files)
    index = read_index(files.select("path", F.lit(0).cast("bigint").alias("from_byte"), F.col("length").alias("to_byte")))
    read = ranges_of_index(index).select("path", "failed")
    listed = files.join(read, "path", "left").withColumn("unread", F.coalesce("failed", F.col("length") > 0)).drop("failed")
    return logs_of(lines_of_index(index), listed, tz, errors)


def load_window_logs(
    spark: SparkSession, root: str, tz: str, today: Column, starts: DataFrame, homes: list[str] | None = None
) -> tuple[SessionLogs, DataFrame]:
    """Only the logs that today's and the period's windows can need, and what was left unread.

    By the listing alone: files of a date folder inside a window or written late
    enough (see ``operators.windows.select_files``), and then, as their first
    records tell them, the files of the parents they were forked from, level by
    level. ``starts``: ``home, period_start_date`` of homes with a known period.
    Other files are not opened and have no row. Returns per home
    ``files_listed, files_read, files_pruned, bytes_read`` too.
    """
    files, errors = discover(spark, root, homes)
    placed = files.join(starts.select("home", "period_start_date"), "home", "left")
    written = local_date(F.unix_micros("modified_at") * 1000, tz)
    first = F.least(F.col("period_start_date"), F.date_sub(today, 1))
    needed = (F.col("partition_date") == today) | F.col("partition_date").between(F.col("period_start_date"), today) | (written >= first)
    listed = settle(placed.withColumn("_needed", F.coalesce(needed, F.lit(False))).drop("period_start_date"))
    wanted = listed.where("_needed").drop("_needed")
    lines, read = [], []
    while True:
        index = read_index(wanted.select("path", F.lit(0).cast("bigint").alias("from_byte"), F.col("length").alias("to_byte")))
        found = lines_of_index(index)
        status = ranges_of_index(index).select("path", "failed", "bytes_read")
        wanted = settle(wanted.join(status, "path", "left").withColumn("unread", F.coalesce("failed", F.col("length") > 0)).drop("failed"))
        lines.append(found)
        read.append(wanted)
        parents = file_table(found, wanted, tz).where("parent_kind = 'parent'").select("home", F.col("parent_id").alias("filename_thread_id")).distinct()
        seen = read[0].select(*FILE)
        for more in read[1:]:
            seen = seen.union(more.select(*FILE))
        wanted = settle(listed.drop("_needed").join(parents, ["home", "filename_thread_id"], "left_semi").join(seen, list(FILE), "left_anti"))
        if wanted.isEmpty():
            break
    all_lines, all_read = lines[0], read[0]
    for more_lines, more_read in zip(lines[1:], read[1:], strict=True):
        all_lines, all_read = all_lines.unionByName(more_lines), all_read.unionByName(more_read)
    counts = listed.select(*FILE).join(all_read.select(*FILE, F.coalesce("bytes_read", F.lit(0)).alias("bytes_read"), F.lit(1).alias("_read")), list(FILE), "left")
    counts = counts.groupBy("home").agg(
        F.count(F.lit(1)).alias("files_listed"), F.count("_read").alias("files_read"), F.count_if(F.col("_read").isNull()).alias("files_pruned"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"),
    )
    return logs_of(all_lines, all_read.drop("bytes_read"), tz, errors), counts
