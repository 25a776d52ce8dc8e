"""Raw inputs (log text, service responses, price sheets) spelled out from the
driver tables, one input per row, to run the text sources over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.fixed_values import LONG_COLUMNS, SHORT_COLUMNS, UNIT_LINE, USAGE_LIMIT_ID
from tallyspark.functions.counters import counter_struct_type
from tallyspark.sources.event_feed import _columns, event_rows


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    basics, feed = _columns("spark")
    rows = event_rows(spark, sf_dir).selectExpr(*[f"{e} as {n}" for n, e in basics.items()])
    return rows.selectExpr(*[f"{e} as {n}" for n, e in feed.items()])


def log_text(spark: SparkSession, sf_dir: str, cut_lines: bool = True) -> DataFrame:
    """Every event as the JSON line a session log would hold for it. Every
    97th line is cut short, as a crash would leave it, if ``cut_lines``."""
    rows = _feed(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros(F.expr("ts_nanos div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def counters(side: str) -> Column:
        fields = [F.col(f"{side}_{f.name}").alias(f"{f.name}_tokens") for f in counter_struct_type(False)]
        return F.when(F.col(f"has_{side}"), F.struct(*fields))

    limits = F.struct(
        F.col("source").alias("limit_id"),
        F.when(F.col("primary_percent").isNotNull(), F.struct(
            F.col("primary_percent").alias("used_percent"), F.lit(300).alias("window_minutes"), F.col("primary_resets_at").alias("resets_at"),
        )).alias("primary"),
        F.when(F.col("balance").isNotNull(), F.struct(F.format_string("%.10f", "balance").alias("balance"))).alias("credits"),
    )
    token = F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit("event_msg").alias("type"),
        F.struct(
            F.lit("token_count").alias("type"),
            F.struct(counters("total").alias("total_token_usage"), counters("last").alias("last_token_usage")).alias("info"),
            limits.alias("rate_limits"),
        ).alias("payload"),
    ))
    context = F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.col("model_set").alias("model")).alias("payload"),
    ))
    change = F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit("event_msg").alias("type"),
        F.struct(F.lit("thread_settings_applied").alias("type"), F.struct(F.lit("x").alias("model"), F.col("tier_raw").alias("service_tier")).alias("thread_settings")).alias("payload"),
    ))
    line = F.when(F.col("kind") == "token", token).when(F.col("kind") == "model", context).otherwise(change)
    cut = F.when(F.lit(cut_lines) & (F.col("line_no") % 97 == 96), F.expr("left(_line, length(_line) - 1)")).otherwise(F.col("_line"))
    return rows.select("home", "user_id", "line_no", "ts_nanos", line.alias("_line")).select("home", "user_id", "line_no", "ts_nanos", cut.alias("value"))


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit responses as JSON bodies, one for each event; by ``k`` some
    lack the preferred bucket, a primary window, or carry a negative reset or
    broken text. Events of other sources name another bucket, so the parser has
    to fall back to the general one."""
    rows = _feed(spark, sf_dir).selectExpr(
        "home", "ts_nanos", "k", f"if(source = '{USAGE_LIMIT_ID}', source, 'elsewhere') as bucket",
        "coalesce(primary_percent, cast(k % 101 as double)) as primary_percent", "coalesce(secondary_percent, cast(k % 103 as double)) as secondary_percent",
        "coalesce(primary_resets_at, 1700000000 + k) as primary_resets_at", "coalesce(secondary_resets_at, 1800000000 + k) as secondary_resets_at",
    )
    bucket = """named_struct('limitId', '{0}',
        'primary', if(k % 10 = 3, null, named_struct('usedPercent', primary_percent, 'windowDurationMins', 300L,
            'resetsAt', if(k % 10 = 4, -1L, primary_resets_at))),
        'secondary', if(k % 10 = 5, null, named_struct('usedPercent', secondary_percent, 'windowDurationMins', 10080L, 'resetsAt', secondary_resets_at)))"""
    named = bucket.format("{0}").replace("'{0}'", "bucket")
    body = f"""to_json(named_struct('rateLimits', if(k % 10 = 6, null, {bucket.format('general')}),
        'rateLimitsByLimitId', if(k % 10 in (6, 8), null, map(bucket, {named}))))"""
    return rows.select(
        "home", F.expr("concat('account-', home)").alias("account_id"), F.col("ts_nanos").alias("received_nanos"),
        F.expr(f"if(k % 10 = 9, left({body}, 20), {body})").alias("body"),
    )


def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account responses as JSON bodies, one for each event; by ``k`` some name
    no plan, have no account, or are broken text."""
    body = """to_json(named_struct('account', if(k % 7 = 2, null, named_struct('type', 'user',
        'planType', if(k % 7 = 3, null, concat('plan-', k % 5))))))"""
    return _feed(spark, sf_dir).select(
        "home", F.col("ts_nanos").alias("received_nanos"), F.expr(f"if(k % 7 = 4, left({body}, length({body}) - 1), {body})").alias("body")
    )


def split_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sets of latest limits of each home, from events that alternate; some
    homes are in one of them only, some looks name no plan."""
    looks = _feed(spark, sf_dir).selectExpr(
        "home", "user_id", "k", "ts_nanos", "named_struct('used_percent', cast(k % 101 as double), 'window_minutes', 300L, 'resets_at', 1700000000 + k) as primary",
        "if(k % 3 = 0, null, named_struct('used_percent', cast(k % 103 as double), 'window_minutes', 10080L, 'resets_at', 1800000000 + k)) as secondary",
        "if(k % 2 = 0, concat('plan-', k % 5), null) as plan_type",
    )

    def latest(rows: DataFrame) -> DataFrame:
        look = F.struct("ts_nanos", "primary", "secondary", "plan_type")
        return rows.groupBy("home").agg(F.max_by(look, F.struct("ts_nanos", "k")).alias("_l")).select("home", "_l.*")

    return latest(looks.where("k % 4 < 2 and user_id % 5 <> 1")), latest(looks.where("k % 4 >= 2 and user_id % 5 <> 2"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small price sheet per part; by key some are faulty."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "cast(p_partkey as bigint) as k", "cast(floor(p_retailprice) as bigint) as price"
    )
    head = "| Model | " + " | ".join([*SHORT_COLUMNS, *LONG_COLUMNS]) + " |"
    rule = "|" + " --- |" * 7

    def table(tier: str, factor: int) -> Column:
        cheap = F.concat(F.lit("| part-"), F.col("k").cast("string"), F.lit(" | $"), (F.col("price") * factor).cast("string"),
                         F.lit(" | - | $"), F.format_string("%,d", F.col("price") * 10 * factor), F.lit(".50 | - | - | - |"))
        wide = F.concat(F.lit("| wide-"), F.col("k").cast("string"), F.lit(" | $1 | $0.5 | $2 | $"), F.col("price").cast("string"),
                        F.lit(" | - | $"), F.when(F.col("k") % 5 == 4, "-3").otherwise("3"), F.lit(" |"))
        return F.concat_ws("\n", F.lit(f"### {tier} pricing data"), F.lit(head), F.lit(rule), cheap, wide)

    unit = F.when(F.col("k") % 5 == 1, "Prices per unit.").otherwise(UNIT_LINE)
    limit = F.when(F.col("k") % 5 == 2, "128K").otherwise("272K")
    threshold = F.concat(F.lit("Short context: ≤"), limit, F.lit(" input tokens. Long context: >"), limit, F.lit(" input tokens."))
    fast = F.when(F.col("k") % 5 != 3, table("Fast", 2))
    text = F.concat_ws("\n", F.lit("## Flagship models"), unit, threshold, table("Standard", 1), fast, table("Ultrafast", 4))
    return parts.select(F.col("k").cast("string").alias("sheet_id"), text.alias("text"))
