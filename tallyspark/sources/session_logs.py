"""Session logs (JSON Lines) to parsed lines and a table of their files.

The raw text is read once. Each line is reduced to the usage fields in the
same stage; prompts and other content never leave it and are never stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.fixed_values import LINE_MARKERS, UNCERTAIN_MARKERS, USAGE_LIMIT_ID
from tallyspark.functions import json_fields as J
from tallyspark.functions.counters import tier_kind
from tallyspark.operators.carry import FILE
from tallyspark.operators.windows import local_date
from tallyspark.session import settle

# Where logs live below a home folder. ``sessions`` may nest
# three folders deep, ``archived_sessions`` holds files only.
LOG_PATH = r"^(.*)/(?:sessions/(?:[^/]+/){0,3}|archived_sessions/)[^/]+\.jsonl$"
THREAD_ID = r"(?:^|-)([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})$"
DATE_FOLDER = r"(?i)(?:^|/)sessions/(\d{4})/(\d{2})/(\d{2})(?:/|$)"


#: Names of the two kinds of log folder below a home.
LOG_FOLDERS = ("sessions", "archived_sessions")
LISTING = "path string, length bigint, modified_at timestamp, readable boolean"


@dataclass
class SessionLogs:
    """``discovery``: per home, folders that could not be listed (``home, errors``)."""

    lines: DataFrame
    files: DataFrame
    discovery: DataFrame | None = None


@dataclass
class LogFolders:
    """Where logs are: folders to read, hidden files among them, and folders that could not be listed."""

    folders: list[str]
    hidden: list[tuple[str, int, int]]
    failed: list[str]


def thread_id_of(path: Column) -> Column:
    """Thread id in a file name; a resume suffix after ``_`` is cut off."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    found = F.regexp_extract(F.element_at(F.split(stem, "_"), 1), THREAD_ID, 1)
    return F.when(found != "", F.lower(found))


def date_folder_of(path: Column) -> Column:
    parts = [F.regexp_extract(path, DATE_FOLDER, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts).try_cast("date"))


def find_log_folders(spark: SparkSession, root: str, homes: list[str] | None = None) -> LogFolders:
    """The log folders of every home below ``root``, or of the given homes.

    Spark's own listing leaves out names that start with a dot or underscore,
    which is where these logs are by default. So folders down to the log
    folders, and hidden ones within them, are found by name here and read as
    roots of their own; visible contents of a log folder are left to Spark.
    With very many homes pass them, and no tree is walked to find them.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    top = Path(root)
    fs = top.getFileSystem(conf)
    found = LogFolders([], [], [])

    def children(path):
        try:
            return list(fs.listStatus(path))
        except Exception:  # noqa: BLE001  a folder that cannot be listed is reported, not skipped
            found.failed.append(path.toString())
            return []

    def hidden_below(folder, depth: int) -> None:
        """Hidden folders are roots; hidden files no reader of Spark opens."""
        pattern = _escaped(folder.toString())
        for level in range(depth + 1):
            try:
                statuses = fs.globStatus(Path(pattern + "/*" * level + "/{.*,_*}"))
            except Exception:  # noqa: BLE001
                found.failed.append(folder.toString())
                return
            for status in statuses or []:
                if status.isDirectory() and level < depth:
                    found.folders.append(status.getPath().toString())
                elif status.isFile() and status.getPath().getName().endswith(".jsonl"):
                    found.hidden.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))

    waiting = [Path(h) for h in homes] if homes is not None else [top]
    while waiting:
        for status in children(waiting.pop()):
            if not status.isDirectory():
                continue
            if status.getPath().getName() in LOG_FOLDERS:
                found.folders.append(status.getPath().toString())
                hidden_below(status.getPath(), 3 if status.getPath().getName() == "sessions" else 0)
            elif homes is None:
                waiting.append(status.getPath())
    if homes is None and fs.exists(top) and top.getName() in LOG_FOLDERS:
        found.folders.append(top.toString())
        hidden_below(top, 3 if top.getName() == "sessions" else 0)
    return found


def _escaped(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def plain_path(encoded: Column) -> Column:
    """The path that a percent-encoded file URI stands for; a plus sign is one."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def list_log_files(spark: SparkSession, root: str, where: LogFolders | None = None) -> DataFrame:
    """Files by metadata alone: ``home, path, length, modified_at``, whether
    they can be read, and the thread id and date folder in the name. No content
    is read."""
    where = where or find_log_folders(spark, root)
    hidden = spark.createDataFrame(where.hidden, "path string, length bigint, millis bigint").select(
        "path", "length", F.timestamp_millis("millis").alias("modified_at"), F.lit(False).alias("readable")
    )
    if not where.folders:
        return _named(hidden)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .load([_escaped(f) for f in where.folders])
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"), "length",
            F.col("modificationTime").alias("modified_at"), F.lit(True).alias("readable"),
        )
    )
    return _named(listed.where(F.col("path").rlike(LOG_PATH)).union(hidden))


def _named(df: DataFrame) -> DataFrame:
    return df.select(
        F.regexp_extract("path", LOG_PATH, 1).alias("home"),
        *df.columns,
        thread_id_of(F.col("path")).alias("filename_thread_id"),
        date_folder_of(F.col("path")).alias("partition_date"),
    )


def read_raw_lines(
    spark: SparkSession, root: str, since: Column | None = None, where: LogFolders | None = None
) -> DataFrame:
    """Log text with its place: file, split start and row order in the split.

    ``since`` keeps files written at or after that time. Both conditions are on
    file metadata and stand below the row numbers, so other files are not opened.
    """
    where = where or find_log_folders(spark, root)
    place = "value string, path string, file_size bigint, block bigint, _seq bigint"
    if not where.folders:
        return spark.createDataFrame([], place)
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .option("lineSep", "\n")
        .text([_escaped(f) for f in where.folders])
        .where(F.col("_metadata.file_path").rlike(LOG_PATH))
    )
    if since is not None:
        text = text.where(F.col("_metadata.file_modification_time") >= since)
    return text.select(
        "value",
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def parse_text(df: DataFrame) -> DataFrame:
    """Reduce each line's ``value`` to the usage fields; drops the text."""
    value = F.col("value")
    valid = F.is_valid_utf8(value)
    marked = valid & _mentions(value, LINE_MARKERS)
    others = [c for c in df.columns if c != "value"]
    opened = df.select(
        *others,
        valid.alias("is_utf8"),
        marked.alias("is_marked"),
        (marked & _mentions(value, UNCERTAIN_MARKERS)).alias("_vital"),
        ((value == "") | (F.startswith(value, F.lit("\r")) & (F.rtrim(value, F.lit("\r")) == ""))).alias("is_empty"),
        F.octet_length(value).alias("n_bytes"),
        F.when(marked, F.try_parse_json(value)).alias("doc"),
    )
    return _fields(opened, others)


def _mentions(value: Column, markers) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(value, F.lit(marker))
    return found


def _fields(df: DataFrame, others: list[str]) -> DataFrame:
    """Typed fields in three steps; each reads columns of the one before, so
    no JSON path is walked twice."""
    doc = F.col("doc")
    line = ["is_utf8", "is_marked", "is_empty", "n_bytes", "_vital"]
    opened = df.select(
        *others,
        *line,
        (F.col("is_marked") & doc.isNull()).alias("is_broken"),
        J.text(J.raw(doc, "$.timestamp")).alias("_stamp"),
        J.text(J.raw(doc, "$.type")).alias("_type"),
        J.text(J.raw(doc, "$.payload.type")).alias("_payload_type"),
        J.raw(doc, "$.payload").alias("_payload"),
    )
    payload = F.col("_payload")
    is_event = F.col("_type") == "event_msg"
    parts = opened.select(
        *others,
        *line,
        "is_broken",
        "_stamp",
        F.when(F.col("_type") == "session_meta", "meta")
        .when(F.col("_type") == "turn_context", "model")
        .when(is_event & (F.col("_payload_type") == "thread_settings_applied"), "settings")
        .when(is_event & (F.col("_payload_type") == "token_count"), "token")
        .alias("kind"),
        "_payload",
        J.raw(payload, "$.thread_settings").alias("_settings"),
        J.raw(payload, "$.info.total_token_usage").alias("_total"),
        J.raw(payload, "$.info.last_token_usage").alias("_last"),
        J.raw(payload, "$.rate_limits").alias("_limits"),
        J.text(J.raw(payload, "$.rate_limits.limit_id")).alias("_limit_id"),
    )
    kind = F.col("kind")
    ours = (kind == "token") & (F.col("_limit_id") == USAGE_LIMIT_ID)
    has_settings = J.kind(F.col("_settings")).startswith("OBJECT")
    tier = F.when(kind == "model", J.raw(F.col("_payload"), "$.service_tier")).when(
        (kind == "settings") & has_settings, J.raw(F.col("_settings"), "$.service_tier")
    )
    pieces = parts.select(
        *others,
        *line,
        "is_broken",
        J.rfc3339_nanos(F.col("_stamp")).alias("ts_nanos"),
        "kind",
        F.when(kind == "model", J.filled_text(J.raw(F.col("_payload"), "$.model"))).alias("model_set"),
        tier.alias("_tier"),
        ((kind == "settings") & F.coalesce(has_settings, F.lit(False))).alias("_full_settings"),
        F.when(kind == "token", F.nullif("_limit_id", F.lit(""))).alias("source"),
        F.when(kind == "token", J.counter_values(F.col("_total"))).alias("_total"),
        F.when(kind == "token", J.counter_values(F.col("_last"))).alias("_last"),
        F.when(ours, J.number(J.raw(F.col("_limits"), "$.primary.used_percent"))).alias("primary_percent"),
        F.when(ours, J.number(J.raw(F.col("_limits"), "$.secondary.used_percent"))).alias("secondary_percent"),
        F.when(ours, _balance(J.raw(F.col("_limits"), "$.credits.balance"))).alias("balance"),
        F.when(ours, _window(J.raw(F.col("_limits"), "$.primary"))).alias("_primary"),
        F.when(ours, _window(J.raw(F.col("_limits"), "$.secondary"))).alias("_secondary"),
        F.when(ours, J.filled_text(J.raw(F.col("_limits"), "$.plan_type"))).alias("_plan"),
        F.when(kind == "meta", _root(F.coalesce(F.col("_payload"), F.parse_json(F.lit("{}"))))).alias("root"),
    )
    tier, primary, secondary = F.col("_tier"), F.col("_primary"), F.col("_secondary")
    tier_text = J.text(tier)
    # A turn context that omits the tier keeps it; a settings record is a full
    # snapshot, so there an omitted tier is a cleared one.
    sets_tier = F.col("_full_settings") | F.coalesce((kind == "model") & tier.isNotNull(), F.lit(False))
    # A usable reading needs a complete primary window.
    limits = F.struct(
        primary.alias("primary"), F.when(_complete(secondary), secondary).alias("secondary"), F.col("_plan").alias("plan_type")
    )
    return pieces.select(
        *others,
        *line,
        "is_broken",
        "ts_nanos",
        "kind",
        "model_set",
        sets_tier.alias("sets_tier"),
        F.when(J.present(tier), F.coalesce(tier_kind(tier_text), F.lit("unknown"))).alias("tier_set_kind"),
        F.when(J.present(tier), F.coalesce(tier_text, F.to_json(tier))).alias("tier_set_text"),
        "source",
        J.counters(F.col("_total")).alias("total"),
        J.counters(F.col("_last")).alias("last"),
        "primary_percent",
        "secondary_percent",
        "balance",
        F.when(_complete(primary), limits).alias("limits"),
        "root",
    )


def _balance(value: Column) -> Column:
    decimal_text = J.text(value)
    plain = F.when(decimal_text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), decimal_text.try_cast("double"))
    return F.coalesce(plain, J.number(value))


def _window(value: Column) -> Column:
    return F.struct(
        J.number(J.raw(value, "$.used_percent")).alias("used_percent"),
        J.unsigned(J.raw(value, "$.window_minutes")).cast("bigint").alias("window_minutes"),
        J.signed(J.raw(value, "$.resets_at")).alias("resets_at"),
    )


def _complete(window: Column) -> Column:
    return (
        window.getField("used_percent").isNotNull()
        & window.getField("window_minutes").isNotNull()
        & window.getField("resets_at").isNotNull()
    )


def _root(payload: Column) -> Column:
    parents = F.array_distinct(
        F.array_compact(
            F.array(
                J.filled_text(J.raw(payload, "$.forked_from_id")),
                J.filled_text(J.raw(payload, "$.parent_thread_id")),
                J.filled_text(J.raw(payload, "$.source.subagent.thread_spawn.parent_thread_id")),
            )
        )
    )
    return F.struct(
        J.filled_text(J.first_present_key(payload, "$.id", "$.thread_id", "$.threadId")).alias("own_id"),
        J.filled_text(J.first_present_key(payload, "$.model_provider", "$.modelProvider")).alias("provider"),
        parents.alias("parents"),
    )


def load_with_readers(spark: SparkSession, root: str, tz: str, homes: list[str] | None = None) -> SessionLogs:
    """``log_scan.load_session_logs`` with Spark's own readers, for stores that nothing else reaches."""
    where = find_log_folders(spark, root, homes)
    listed = list_log_files(spark, root, where)
    # One pass over the text; non-usage lines keep their length and nothing else.
    index = settle(parse_text(read_raw_lines(spark, root, where=where)))
    logs = from_index(index, listed, tz)
    logs.discovery = discovery_errors(spark, where)
    return logs


def discovery_errors(spark: SparkSession, where: LogFolders) -> DataFrame:
    """``home, errors``: folders that could not be listed.

    A folder outside a log folder stands for a home of its own, so that what
    lies below it has a row that says it is unknown.
    """
    inside = rf"^(.*)/(?:{'|'.join(LOG_FOLDERS)})(?:/.*)?$"
    rows = [((m[1] if (m := re.match(inside, f)) else f), 1) for f in where.failed]
    return spark.createDataFrame(rows, "home string, errors bigint").groupBy("home").agg(F.sum("errors").alias("errors"))


def from_index(index: DataFrame, listed: DataFrame, tz: str) -> SessionLogs:
    """Drop unterminated tails, number the lines and sum up the files."""
    sizes = index.groupBy("path").agg(
        F.sum(F.col("n_bytes") + 1).alias("_bytes"),
        F.max("file_size").alias("_size"),
        F.max(F.struct("block", "_seq")).alias("_tail"),
    )
    # The separator of the last line is missing: the line is still being
    # written and is not consumed yet.
    open_tails = sizes.where(F.col("_bytes") > F.col("_size")).select(
        "path", F.col("_tail.block").alias("block"), F.col("_tail._seq").alias("_seq")
    )
    kept = index.where(~F.col("is_empty")).join(open_tails, ["path", "block", "_seq"], "left_anti")
    relevant = kept.where(~F.col("is_utf8") | F.col("is_marked"))
    in_split = Window.partitionBy("home", "path", "block").orderBy("_seq")
    # Fewer lines than bytes: split start + row number rises through the file.
    numbered = relevant.withColumn("home", F.regexp_extract("path", LOG_PATH, 1)).withColumn(
        "line_no", F.col("block") + F.row_number().over(in_split) - 1
    )
    numbered = numbered.withColumn(
        "is_token", (F.col("kind") == "token") & (F.col("total").isNotNull() | F.col("last").isNotNull())
    ).withColumn("is_token", F.coalesce("is_token", F.lit(False)))
    lines = settle(numbered.drop("_seq", "n_bytes", "file_size", "is_empty"))
    read = sizes.select("path", F.lit(True).alias("_read"))
    listed = listed.join(read, "path", "left")
    # A file that has bytes and gave no line was listed, but not read.
    listed = listed.withColumn("unread", ~F.col("readable") | ((F.col("length") > 0) & F.col("_read").isNull())).drop("_read")
    return SessionLogs(lines=lines.where("is_marked and not is_broken"), files=file_table(lines, listed, tz))


def file_table(lines: DataFrame, listed: DataFrame, tz: str) -> DataFrame:
    """One row per listed file: identity, first metadata record and health."""
    health = lines.groupBy(*FILE).agg(
        F.max(F.when(~F.col("is_broken") & F.col("is_utf8"), F.col("ts_nanos"))).alias("last_line_ts"),
        F.count_if(~F.col("is_utf8") | F.col("is_broken")).alias("parse_errors"),
        F.bool_or(~F.col("is_utf8") | (F.col("is_broken") & F.col("_vital"))).alias("uncertain"),
        F.bool_or(F.col("is_token") & F.col("ts_nanos").isNull()).alias("token_without_timestamp"),
        F.min_by(
            F.struct("ts_nanos", "root"), F.when(F.col("root").isNotNull(), F.col("line_no"))
        ).alias("_root"),
    )
    named, own = F.col("filename_thread_id"), F.col("_root.root.own_id")
    parents = F.coalesce("_root.root.parents", F.array().cast("array<string>"))
    thread = F.coalesce(named, own)
    parent = F.try_element_at(parents, F.lit(1))
    ambiguous = F.coalesce(named != own, F.lit(False)) | (F.size(parents) > 1) | F.coalesce(parent == thread, F.lit(False))
    false = F.lit(False)
    return listed.join(health, list(FILE), "left").select(
        *FILE,
        "length",
        "modified_at",
        "filename_thread_id",
        thread.alias("thread_id"),
        F.col("_root.root.provider").alias("provider"),
        F.col("_root.root").isNotNull().alias("has_root"),
        F.col("_root.ts_nanos").alias("root_ts"),
        F.when(ambiguous, "ambiguous").when(parent.isNotNull(), "parent").otherwise("none").alias("parent_kind"),
        F.when(~ambiguous, parent).alias("parent_id"),
        F.coalesce("uncertain", false).alias("uncertain"),
        F.coalesce("token_without_timestamp", false).alias("token_without_timestamp"),
        F.coalesce("parse_errors", F.lit(0)).alias("parse_errors"),
        false.alias("compacted"),
        F.lit(None).cast("bigint").alias("history_start_nanos"),
        F.coalesce("unread", false).alias("unread"),
        "partition_date",
        local_date(F.unix_micros("modified_at") * 1000, tz).alias("modified_date"),
        "last_line_ts",
    )
