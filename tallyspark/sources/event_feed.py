"""Session-log lines derived from the ``events`` table.

The driver tables hold no session logs. Every column here is a function of one
``events`` row (no window, no shuffle), so the feed costs a single scan at any
size; ``event_id`` is the line number. The same expressions are spelled once
and rendered for Spark and for the SQL the results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.fixed_values import USAGE_LIMIT_ID
from tallyspark.functions.counters import NARROW, counter_struct_type
from tallyspark.operators.blocks import BLOCK_ROWS, with_blocks

AS_OF = "2024-01-30 23:59:59"
SPLIT_DAY = "2024-01-15 00:00:00"
RESUME_DAY = "2024-01-16 00:00:00"
OVERLAP_FROM = "2024-01-10 00:00:00"
OVERLAP_TO = "2024-01-20 00:00:00"
FIRST_HALF_DAY = 39445  # half days from 1970-01-01 to 2024-01-01, minus one

_DIALECT = {
    "spark": {
        "k": "cast(get_json_object(props, '$.k') as bigint)",
        "nanos": "unix_micros(cast(ts as timestamp)) * 1000",
        "div": "({0} div {1})",
        "floor": "cast(floor({0}) as bigint)",
        "ts": "unix_micros(timestamp'{0}') * 1000",
    },
    "duckdb": {
        "k": "cast(json_extract_string(props, '$.k') as bigint)",
        "nanos": "epoch_us(ts) * 1000",
        "div": "({0} // {1})",
        "floor": "cast(floor({0}) as bigint)",
        "ts": "epoch_us(timestamp '{0}') * 1000",
    },
}


def _columns(dialect: str) -> tuple[dict[str, str], dict[str, str]]:
    """Two layers of expressions: basics over ``events``, then the feed."""
    d = _DIALECT[dialect]

    def div(a: str, b: str) -> str:
        return d["div"].format(a, b)

    basics = {
        "event_id": "event_id",
        "user_id": "user_id",
        "event_type": "event_type",
        "value": "value",
        "k": d["k"],
        "ts_nanos": d["nanos"],
    }
    hour = div("ts_nanos", "3600000000000")
    half_day = f"({div('ts_nanos', '43200000000000')} - {FIRST_HALF_DAY})"
    level = f"(case when k % 13 = 0 then greatest({half_day} - 3, 1) else {half_day} end)"
    big_input = f"({d['floor'].format('value * 1000')} + 1)"
    last_input = f"(case when k % 3 = 0 then {half_day} * 300 else {big_input} end)"
    last_output = f"(case when k % 3 = 0 then {half_day} * 7 else {d['floor'].format('value * 10')} + 1 end)"
    last_cached = (
        f"(case when k % 3 = 0 then {half_day} * 50 else {div(f'({last_input} * (k % 10))', '10')} end)"
    )
    token = "event_type in ('view', 'click', 'purchase')"
    usage_source = f"({token} and k % 7 <> 0)"
    has_total = f"({token} and k % 19 <> 0)"
    has_last = f"({token} and (k % 11 <> 0 or k % 19 = 0))"
    feed = {
        "home": div("user_id", "4"),
        "user_id": "user_id",
        "line_no": "event_id",
        "ts_nanos": "ts_nanos",
        "k": "k",
        "kind": f"case when event_type = 'signup' then 'model' when event_type = 'error' then 'settings' else 'token' end",
        "is_token": token,
        "model_set": (
            "case when event_type = 'signup' then concat('m', cast(k % 5 as varchar(4)), "
            "case when k % 7 = 0 then '-2024-01-05' when k % 17 = 0 then '-2024-02-30' else '' end) end"
        ),
        "sets_tier": "event_type = 'error'",
        "tier_raw": (
            "case when event_type = 'error' then case k % 5 when 0 then 'default' when 1 then 'priority' "
            "when 2 then 'ultrafast' when 4 then 'flex' end end"
        ),
        "source": f"case when {usage_source} then '{USAGE_LIMIT_ID}' when {token} then 'other' end",
        "has_total": has_total,
        "has_last": has_last,
        "total_input": f"case when {has_total} and k % 23 <> 0 then {level} * 20000 end",
        "total_cached_input": f"case when {has_total} then {level} * 5000 end",
        "total_cache_write_input": f"case when {has_total} then cast(0 as bigint) end",
        "total_output": f"case when {has_total} and k % 23 <> 0 then {level} * 1000 end",
        "total_reasoning_output": f"case when {has_total} then {level} * 100 end",
        "total_total": f"case when {has_total} and (k % 12 <> 4 or k % 23 = 0) then {level} * 21000 end",
        "last_input": f"case when {has_last} then {last_input} end",
        "last_cached_input": f"case when {has_last} then {last_cached} end",
        "last_cache_write_input": f"case when {has_last} then cast(0 as bigint) end",
        "last_output": f"case when {has_last} and k % 29 <> 0 then {last_output} end",
        "last_reasoning_output": f"case when {has_last} then cast(3 as bigint) end",
        "last_total": f"case when {has_last} and (k % 3 = 0 or k % 2 = 1) then {last_input} + {last_output} end",
        "primary_percent": f"case when {usage_source} then cast(least(100, 5 * ({hour} % 26)) as double) end",
        "secondary_percent": f"case when {usage_source} then cast({half_day} as double) * 1.5 end",
        "balance": (
            f"case when {usage_source} and k % 4 <> 1 then 1000.0e0 "
            f"- 0.37e0 * cast({div('ts_nanos', '600000000000')} % 1008 as double) "
            f"+ 0.001e0 * cast(user_id % 10 as double) end"
        ),
        "primary_resets_at": f"case when {usage_source} then ({div('ts_nanos', '18000000000000')} + 1) * 18000 end",
        "secondary_resets_at": f"case when {usage_source} then ({div('ts_nanos', '604800000000000')} + 1) * 604800 end",
        "plan_type": f"case when {usage_source} then case k % 6 when 0 then 'plus' when 1 then 'pro' when 2 then 'team' end end",
    }
    return basics, feed


def feed_sql(dialect: str, table: str = "events") -> str:
    """The feed as a SELECT over ``table``, in either dialect."""
    basics, feed = _columns(dialect)
    inner = ", ".join(f"{expr} as {name}" for name, expr in basics.items())
    outer = ", ".join(f"{expr} as {name}" for name, expr in feed.items())
    return f"select {outer} from (select {inner} from {table}) base"


def nanos_literal(text: str, dialect: str) -> str:
    return _DIALECT[dialect]["ts"].format(text)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows dealt over all tasks by ``event_id``.

    A file of few row groups is read by few tasks, however large it is; what is
    derived from a row costs far more than to read it.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")


def event_lines(
    spark: SparkSession, sf_dir: str, variants: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Parsed log lines, one file per user, or with derived files when
    ``variants``: archive copies, resumed, overlapping and forked sessions."""
    basics, feed = _columns("spark")
    rows = event_rows(spark, sf_dir).selectExpr(*[f"{e} as {n}" for n, e in basics.items()])
    rows = rows.selectExpr(*[f"{e} as {n}" for n, e in feed.items()])
    rows = _with_files(rows) if variants else rows.withColumn("path", F.expr("concat('u', user_id)"))
    return with_blocks(_pack(rows), block_rows)


def _with_files(rows: DataFrame) -> DataFrame:
    split, resume = nanos_literal(SPLIT_DAY, "spark"), nanos_literal(RESUME_DAY, "spark")
    start, stop = nanos_literal(OVERLAP_FROM, "spark"), nanos_literal(OVERLAP_TO, "spark")
    rule = rows.withColumn("_rule", F.expr(FILE_RULE))
    placed = rule.withColumn(
        "_file",
        F.explode(
            F.expr(
                f"""filter(array(
              named_struct('path', concat('u', user_id), 'shift', 0L,
                           'take', not (_rule = 'resume' and ts_nanos >= {resume})),
              named_struct('path', concat('u', user_id, '/copy'), 'shift', 0L,
                           'take', _rule = 'copy' and ts_nanos < {split}),
              named_struct('path', concat('u', user_id, '/next'), 'shift', 0L,
                           'take', _rule = 'resume' and ts_nanos >= {resume}),
              named_struct('path', concat('u', user_id, '/over'), 'shift', 1L,
                           'take', _rule = 'overlap' and ts_nanos >= {start} and ts_nanos < {stop}),
              named_struct('path', concat('c', user_id), 'shift', if(ts_nanos <= {split}, 0L, 1L),
                           'take', _rule = 'fork' and (ts_nanos > {split} or k % 31 <> 0))
            ), f -> f.take)"""
            )
        ),
    )
    shifted = placed.withColumn("path", F.col("_file.path"))
    for name in ("total_input", "total_total"):
        shifted = shifted.withColumn(name, F.col(name) + F.col("_file.shift"))
    return shifted.drop("_file", "_rule")


# One rule per user, first match wins; same text in both dialects.
FILE_RULE = (
    "case when user_id % 5 = 0 then 'copy' when user_id % 7 = 0 then 'resume' "
    "when user_id % 13 = 0 then 'overlap' when user_id % 11 = 0 then 'fork' else 'plain' end"
)
PROVIDER_RULE = (
    "case when user_id % 17 = 0 then 'elsewhere' when user_id % 19 = 0 then null else 'openai' end"
)


def _pack(rows: DataFrame) -> DataFrame:
    from tallyspark.functions.counters import tier_kind

    def counters(side: str):
        fields = [F.col(f"{side}_{f.name}").alias(f.name) for f in counter_struct_type(False)]
        packed = F.struct(*[f.cast(NARROW) for f in fields])
        return F.when(F.col(f"has_{side}"), packed.cast(counter_struct_type(False)))

    limits = F.when(
        F.col("primary_percent").isNotNull(),
        F.struct(
            F.struct(
                F.col("primary_percent").alias("used_percent"),
                F.lit(300).cast("bigint").alias("window_minutes"),
                F.col("primary_resets_at").alias("resets_at"),
            ).alias("primary"),
            F.struct(
                F.col("secondary_percent").alias("used_percent"),
                F.lit(10080).cast("bigint").alias("window_minutes"),
                F.col("secondary_resets_at").alias("resets_at"),
            ).alias("secondary"),
            "plan_type",
        ),
    )
    return rows.select(
        "home",
        "path",
        "user_id",
        "line_no",
        "ts_nanos",
        "kind",
        "is_token",
        "model_set",
        "sets_tier",
        tier_kind(F.col("tier_raw")).alias("tier_set_kind"),
        F.col("tier_raw").alias("tier_set_text"),
        "source",
        counters("total").alias("total"),
        counters("last").alias("last"),
        "primary_percent",
        "secondary_percent",
        "balance",
        limits.alias("limits"),
    )


def event_files(lines: DataFrame) -> DataFrame:
    """The file table that belongs to ``event_lines(..., variants=True)``."""
    day = 86_400_000_000_000
    seen = lines.groupBy("home", "path", "user_id").agg(
        F.min("ts_nanos").alias("_from"), F.max("ts_nanos").alias("last_line_ts")
    )

    def date_of(column: str):
        return F.date_from_unix_date(F.expr(f"cast({column} div {day} as int)"))

    forked = F.col("path").startswith("c")
    split = F.expr(nanos_literal(SPLIT_DAY, "spark"))
    thread = F.regexp_extract("path", "^([a-z][0-9]+)", 1)
    return seen.select(
        "home",
        "path",
        "user_id",
        thread.alias("filename_thread_id"),
        thread.alias("thread_id"),
        F.expr(PROVIDER_RULE).alias("provider"),
        F.lit(True).alias("has_root"),
        F.when(forked, split).otherwise(F.col("_from")).alias("root_ts"),
        F.when(forked, "parent").otherwise("none").alias("parent_kind"),
        F.when(forked, F.concat(F.lit("u"), "user_id")).alias("parent_id"),
        (F.col("user_id") % 23 == 0).alias("uncertain"),
        F.lit(False).alias("token_without_timestamp"),
        F.lit(False).alias("compacted"),
        F.lit(False).alias("unread"),
        date_of("_from").alias("partition_date"),
        date_of("last_line_ts").alias("modified_date"),
        "last_line_ts",
    )
