"""Report texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.fixed_values import (
    AGES,
    OVERFLOW_TEXTS,
    PERIOD_NAMES,
    PLAN_CLASSES,
    PLAN_LABELS,
    QUOTA_NAMES,
    RESET_TEXT,
    WINDOW_UNITS,
)

MISSING = "--"


def _tenths(count: Column, unit: int, suffix: str) -> Column:
    wide = count.cast("decimal(24,0)")
    tenths = F.call_function(
        "div", wide * F.lit(10).cast("decimal(2,0)") + F.lit(unit // 2).cast("decimal(12,0)"),
        F.lit(unit).cast("decimal(12,0)"),
    )
    whole, rest = F.call_function("div", tenths, F.lit(10)), tenths % 10
    return F.when(rest == 0, F.concat(whole.cast("string"), F.lit(suffix))).otherwise(
        F.concat(whole.cast("string"), F.lit("."), rest.cast("string"), F.lit(suffix))
    )


# The unit steps of the two number styles, smallest first.
UNIT_STEPS = {
    "zh": ((10_000, "万"), (100_000_000, "亿")),
    "en": ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")),
}


def compact_tokens(count: Column, style: str = "zh") -> Column:
    """``12345`` → ``1.2万`` / ``12.3K``; one decimal, half up, no ``.0``."""
    steps = UNIT_STEPS[style]
    text = F.when(count < steps[0][0], count.cast("string"))
    for (unit, suffix), (limit, _) in zip(steps, steps[1:], strict=False):
        text = text.when(count < limit, _tenths(count, unit, suffix))
    text = text.when(count.isNotNull(), _tenths(count, *steps[-1]))
    return F.coalesce(text, F.lit(MISSING))


def usage_with_hit(count: Column, hit_tenths: Column, style: str = "zh") -> Column:
    usage = compact_tokens(count, style)
    shown = F.least(hit_tenths, F.lit(1000)).cast("bigint")
    rate = F.concat(
        F.call_function("div", shown, F.lit(10)).cast("string"),
        F.lit("."),
        (shown % 10).cast("string"),
        F.lit("%"),
    )
    return F.when(
        count.isNotNull() & hit_tenths.isNotNull(), F.concat(usage, F.lit(" · "), rate)
    ).otherwise(usage)


def usd(amount: Column) -> Column:
    return (
        F.when(amount <= 0, "$0.00")
        .when(amount >= 100, F.format_string("$%.0f", F.bround(amount.cast("double"))))
        .when(amount.isNotNull(), F.format_string("$%.2f", amount.cast("double")))
        .otherwise(MISSING)
    )


def compact_countdown(seconds: Column) -> Column:
    minutes = F.call_function("div", seconds.cast("bigint"), F.lit(60))
    days = F.call_function("div", minutes, F.lit(1440))
    hours = F.call_function("div", minutes % 1440, F.lit(60))
    left = minutes % 60

    def part(value: Column, unit: str) -> Column:
        return F.concat(value.cast("string"), F.lit(unit))

    return (
        F.when((days >= 10) | ((days > 0) & (hours == 0)), part(days, "d"))
        .when(days > 0, F.concat(part(days, "d"), part(hours, "h")))
        .when((hours > 0) & (left == 0), part(hours, "h"))
        .when(hours > 0, F.concat(part(hours, "h"), part(left, "m")))
        .when(left > 0, part(left, "m"))
        .when(seconds.isNotNull(), "<1m")
    )


def window_name(seconds: Column) -> Column:
    """Short name of a window length: 5h, 周, 月, 2周, 3天, 6小时, 45分钟."""
    minutes = F.call_function("div", seconds.cast("bigint"), F.lit(60))

    def whole(unit: int, suffix: str) -> Column:
        return F.concat(F.call_function("div", minutes, F.lit(unit)).cast("string"), F.lit(suffix))

    return (
        F.when(minutes == 300, "5h")
        .when(minutes.between(40_320, 44_640), WINDOW_UNITS["month"])
        .when(minutes == 10_080, WINDOW_UNITS["week"])
        .when((minutes != 0) & (minutes % 10_080 == 0), whole(10_080, WINDOW_UNITS["week"]))
        .when((minutes != 0) & (minutes % 1_440 == 0), whole(1_440, WINDOW_UNITS["day"]))
        .when((minutes != 0) & (minutes % 60 == 0), whole(60, WINDOW_UNITS["hour"]))
        .when(minutes.isNotNull(), F.concat(minutes.cast("string"), F.lit(WINDOW_UNITS["minute"])))
    )


def quota_label(seconds: Column, plan: Column, short: bool) -> Column:
    fallback = (
        F.lit(QUOTA_NAMES["short"]) if short else F.when(plan == "free", QUOTA_NAMES["free"]).otherwise(QUOTA_NAMES["long"])
    )
    return F.coalesce(F.concat(window_name(seconds), F.lit(QUOTA_NAMES["suffix"])), fallback)


def period_label(seconds: Column, plan: Column) -> Column:
    name = window_name(seconds)
    return (
        F.when(name.isNull() & (plan == "free"), PERIOD_NAMES["free"])
        .when(name.isNull(), PERIOD_NAMES["paid"])
        .when(name == "5h", PERIOD_NAMES["short"])
        .otherwise(F.concat(F.lit(PERIOD_NAMES["prefix"]), name))
    )


def _mapped(value: Column, table: dict[str, str], fallback: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(known, value), fallback))


def plan_label(plan: Column) -> Column:
    return _mapped(plan, PLAN_LABELS, plan)


def plan_class(plan: Column) -> Column:
    return _mapped(plan, PLAN_CLASSES, F.lit("unknown"))


def elapsed_label(then_seconds: Column, now_seconds: Column) -> Column:
    gone = (now_seconds - then_seconds).cast("bigint")

    def ago(unit: int, suffix: str) -> Column:
        return F.concat(F.call_function("div", gone, F.lit(unit)).cast("string"), F.lit(suffix))

    return (
        F.when(gone < 60, AGES["now"])
        .when(gone < 3_600, ago(60, AGES["minutes"]))
        .when(gone < 86_400, ago(3_600, AGES["hours"]))
        .when(gone.isNotNull(), ago(86_400, AGES["days"]))
    )


def credits_text(amount: Column) -> Column:
    """Two decimals, whole numbers plain."""
    cents = F.round(amount * 100.0).cast("bigint")
    return F.when(
        cents % 100 == 0, F.call_function("div", cents, F.lit(100)).cast("string")
    ).otherwise(F.format_string("%.2f", cents / 100.0))


def reset_column(seconds: Column, now_seconds: Column, tz: str, countdown: bool = False) -> Column:
    """Local reset time ``MM/dd HH:mm``, with the time left when asked."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)
    text = F.date_format(local, "MM/dd HH:mm")
    if not countdown:
        return text
    left = seconds - now_seconds
    return F.when(left > 0, F.concat(text, F.lit(" ("), compact_countdown(left), F.lit(")"))).otherwise(text)


def reset_text(seconds: Column, remaining: Column) -> Column:
    name = window_name(seconds)
    gap = F.when(name.rlike("[A-Za-z0-9]$"), " ").otherwise("")
    left = F.format_string("%.0f", F.bround(remaining))
    return F.concat(name, gap, F.lit(RESET_TEXT), left, F.lit("%"))


def overflow_text(period: Column, credits: Column, usd_per_credit: float) -> Column:
    return F.concat(
        period, F.lit(OVERFLOW_TEXTS[0]), credits_text(credits), F.lit(OVERFLOW_TEXTS[1]), usd(credits * usd_per_credit), F.lit(OVERFLOW_TEXTS[2])
    )
