from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import display
from tallyspark.operators.alerts import merge_messages
from tallyspark.operators.quota import assign_windows, merge_snapshots, next_pull_delay, quota_status
from tallyspark.operators.windows import local_midnight_nanos
from tallyspark.sources.tables import load_table, save_table


def check(spark, make, cases, kind="bigint"):
    rows = [(i, v) for i, v in enumerate(cases)]
    got = spark.createDataFrame(rows, f"i int, v {kind}").select("i", make(F.col("v")).alias("x")).orderBy("i").collect()
    assert {v: r.x for v, r in zip(cases, got, strict=True)} == cases


def test_numbers(spark):
    check(spark, lambda v: display.compact_tokens(v, "zh"), {
        None: "--", 0: "0", 9_999: "9999", 10_000: "1万", 12_345: "1.2万", 99_950: "10万", 99_999_999: "10000万",
        100_000_000: "1亿", 123_456_789: "1.2亿", 2**62: "46116860184.3亿"})
    check(spark, lambda v: display.compact_tokens(v, "en"), {
        0: "0", 999: "999", 1_000: "1K", 1_050: "1.1K", 999_999: "1000K", 1_000_000: "1M", 1_500_000_000: "1.5B"})
    check(spark, lambda v: display.usage_with_hit(F.lit(5), v), {None: "5", 981: "5 · 98.1%", 2000: "5 · 100.0%"})
    check(spark, display.usd, {None: "--", -1.0: "$0.00", 0.0: "$0.00", 1.239: "$1.24", 99.99: "$99.99", 100.4: "$100", 1234.5: "$1234"}, "double")
    check(spark, display.credits_text, {310.25: "310.25", 12.0: "12", 0.005: "0.01", 1.999: "2"}, "double")


def test_times_and_names(spark):
    minute, hour, day = 60, 3_600, 86_400
    check(spark, display.compact_countdown, {
        30: "<1m", 6 * minute: "6m", 90 * minute: "1h30m", 6 * hour: "6h", 30 * hour: "1d6h", day: "1d", 10 * day + hour: "10d", 9 * day + 23 * hour: "9d23h"})
    check(spark, lambda v: display.window_name(v * 60), {
        300: "5h", 10_080: "周", 43_200: "月", 40_320: "月", 44_641: "44641分钟", 20_160: "2周", 4_320: "3天", 360: "6小时", 45: "45分钟", 0: "0分钟"})
    check(spark, lambda v: display.elapsed_label(F.lit(0), v), {
        -5: "刚刚更新", 59: "刚刚更新", 60: "1分钟前更新", 3_600: "1小时前更新", 2 * day: "2天前更新"})
    check(spark, lambda v: display.period_label(v * 60, F.lit("free")), {None: "本月", 300: "本期", 10_080: "本周", 43_200: "本月"})
    check(spark, lambda v: display.quota_label(v * 60, F.lit("plus"), False), {None: "周额度", 43_200: "月额度"})
    check(spark, display.plan_label, {"pro": "Pro", "prolite": "Pro Lite", "unknown": "未知方案", "new": "new", None: None}, "string")
    check(spark, display.plan_class, {"go": "neutral", "team": "business", "edu": "edu", "new": "unknown"}, "string")
    check(spark, lambda v: display.reset_column(F.lit(1_792_061_393), v, "UTC", True), {
        1_792_061_393: display_time(1_792_061_393), 1_792_061_393 - 5_400: display_time(1_792_061_393) + " (1h30m)"})


def display_time(seconds):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%m/%d %H:%M")


def test_messages(spark):
    check(spark, lambda v: display.reset_text(v, F.lit(99.0)), {18_000: "5h 窗口已重置，当前剩余 99%", 604_800: "周窗口已重置，当前剩余 99%"})
    check(spark, lambda v: display.overflow_text(F.lit("本周"), v, 0.04), {310.25: "本周已扣 310.25 credits（约 $12.41）"}, "double")
    alerts = spark.createDataFrame([("h", 1, "reset", 1, "b"), ("h", 1, "reset", 0, "a"), ("h", 1, "overflow", 0, "c")],
                                   "home string, ts_nanos bigint, kind string, rank int, body string")
    assert {r.kind: r.body for r in merge_messages(alerts).collect()} == {"reset": "a；b", "overflow": "c"}


WINDOW = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
SNAP = f"home string, ts_nanos bigint, primary {WINDOW}, secondary {WINDOW}, plan_type string"


def test_quota_windows(spark):
    s = 10**9
    rows = [
        ("one short", 0, (10.0, 1440, 100), None, None),
        ("one long", 0, (10.0, 1441, 100), None, None),
        ("swapped", 0, (10.0, 10_080, 100), (20.0, 300, 100), None),
        ("negative second", 0, (10.0, 300, 100), (1.0, 10_080, -1), None),
        ("blocked", 0, (100.0, 300, 100), (20.0, 10_080, 100), None),
        ("expired", 0, (100.0, 300, 50), (70.5, 10_080, 100), None),
        ("stale", -700 * s, (10.0, 300, 100), (20.0, 10_080, 100), None),
    ]
    df = quota_status(spark.createDataFrame(rows, SNAP), F.lit(50 * s), 300)
    got = {r.home: (r.short and r.short.used_percent, r.long and r.long.used_percent, r.short_state, r.headline, r.blocked, r.long_colour) for r in df.collect()}
    assert got == {
        "one short": (10.0, None, "ready", 90.0, False, None),
        "one long": (None, 10.0, "unknown", 90.0, False, "healthy"),
        "swapped": (20.0, 10.0, "ready", 80.0, False, "healthy"),
        "blocked": (100.0, 20.0, "ready", 0.0, True, "healthy"),
        "expired": (100.0, 70.5, "updating", 29.5, False, "warning"),
        "stale": (10.0, 20.0, "unknown", None, False, "healthy"),
    }
    assert assign_windows(spark.createDataFrame(rows, SNAP)).count() == 6
    delay = next_pull_delay(spark.createDataFrame(rows[:1], SNAP), F.lit(30 * s), 300).collect()[0]
    assert delay.pull_in_seconds == 70.0


def test_merge_snapshots(spark):
    w = (1.0, 300, 100)
    old = spark.createDataFrame([("a", 5, w, None, "plus"), ("b", 5, w, None, "plus"), ("c", 5, w, None, "pro")], SNAP)
    new = spark.createDataFrame([("a", 5, w, None, None), ("b", 4, w, None, "pro"), ("d", 1, w, None, "go")], SNAP)
    got = {r.home: (r.ts_nanos, r.plan_type) for r in merge_snapshots(old, new).collect()}
    assert got == {"a": (5, "plus"), "b": (5, "plus"), "c": (5, "pro"), "d": (1, "go")}


def test_midnight_that_does_not_exist(spark):
    # Clocks in this zone once jumped at midnight: 2018-11-04 has no 00:00.
    days = spark.createDataFrame([("2018-11-04",), ("2018-11-05",)], "d string").select(F.to_date("d").alias("d"))
    got = [r.n for r in days.select(local_midnight_nanos(F.col("d"), "America/Sao_Paulo").alias("n")).collect()]
    assert got == [None, 1_541_383_200 * 10**9]


def test_tables_of_other_versions_read_as_empty(spark, tmp_path):
    df = spark.createDataFrame([("h", 1)], "home string, n bigint")
    assert load_table(spark, str(tmp_path), "t", df.schema).count() == 0
    save_table(df, str(tmp_path), "t")
    save_table(df.withColumn("n", F.lit(2).cast("bigint")), str(tmp_path), "t")
    assert [r.n for r in load_table(spark, str(tmp_path), "t", df.schema).collect()] == [2]
    assert load_table(spark, str(tmp_path), "t", df.schema, version=99).count() == 0
