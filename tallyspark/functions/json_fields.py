"""Typed reads from a VARIANT that keep missing, null and wrong type apart.

A plain cast would accept ``"100"`` as a number and cannot tell a missing key
from a null one; both change results here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.fixed_values import COUNTER_FIELDS, U64_MAX
from tallyspark.functions.counters import has_value


def raw(doc: Column, path: str) -> Column:
    """The value at ``path``: NULL when missing, variant null when null."""
    return F.try_variant_get(doc, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def present(value: Column) -> Column:
    """Neither missing nor null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def first_present_key(doc: Column, *paths: str) -> Column:
    """Falls through on absence only: a null under the first key wins."""
    return F.coalesce(*[raw(doc, path) for path in paths])


def text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def filled_text(value: Column) -> Column:
    return F.nullif(text(value), F.lit(""))


def unsigned(value: Column) -> Column:
    """Non-negative integer up to 2^64 - 1; ``100.0`` and ``"100"`` are not."""
    small = F.try_variant_get(value, "$", "bigint")
    # Integers past 2^63 arrive as decimals of 19 or 20 digits.
    large = F.try_variant_get(value, "$", "decimal(20,0)")
    top = F.lit(str(U64_MAX)).cast("decimal(20,0)")
    return F.when(kind(value) == "BIGINT", F.when(small >= 0, small).cast("decimal(20,0)")).when(
        kind(value).isin("DECIMAL(19,0)", "DECIMAL(20,0)"), F.when(large.between(0, top), large)
    )


def signed(value: Column) -> Column:
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def number(value: Column) -> Column:
    shape = kind(value)
    numeric = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


# JSON keys of the counters, in the order of COUNTER_FIELDS.
COUNTER_KEYS = (
    ("$.input_tokens",),
    ("$.cached_input_tokens", "$.cache_read_input_tokens"),
    ("$.cache_write_input_tokens",),
    ("$.output_tokens",),
    ("$.reasoning_output_tokens",),
    ("$.total_tokens",),
)


def counter_values(value: Column) -> Column:
    """The six counters as an array; NULL when ``value`` is no object. One
    lambda checks all six, which keeps the generated code small."""
    values = F.transform(F.array(*[first_present_key(value, *keys) for keys in COUNTER_KEYS]), unsigned)
    return F.when(kind(value).startswith("OBJECT"), values)


def counters(values: Column) -> Column:
    """Counter struct from ``counter_values``, NULL when none of them counts."""
    packed = F.struct(*[values.getItem(i).alias(name) for i, name in enumerate(COUNTER_FIELDS)])
    return F.when(values.isNotNull() & has_value(packed), packed)


RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(?:[Zz]|([+-])([01]\d|2[0-3]):([0-5]\d))$"


def rfc3339_nanos(value: Column) -> Column:
    """Epoch nanoseconds of an RFC 3339 text; NULL when it is not one."""
    micros = F.unix_micros(F.upper(value).try_cast("timestamp"))
    beyond = F.regexp_extract(value, r"\.\d{6}(\d{1,3})", 1)
    # Timestamps end at microseconds; the digits after them are added back.
    rest = F.when(beyond != "", F.rpad(beyond, 3, "0").try_cast("bigint")).otherwise(F.lit(0))
    inside = micros.between(-9_223_372_036_000_000, 9_223_372_035_999_999)
    usual = F.when(inside, micros * F.lit(1000) + rest)
    return F.when(value.rlike(RFC3339), F.coalesce(usual, _by_parts(value)))


def _by_parts(value: Column) -> Column:
    """The same for offsets wider than Spark's own timestamps allow."""

    def group(index: int) -> Column:
        return F.regexp_extract(value, RFC3339, index)

    whole = F.concat(group(1), F.lit("T"), group(2), F.lit("Z")).try_cast("timestamp")
    sign = F.when(group(4) == "-", F.lit(-1)).when(group(4) == "+", F.lit(1)).otherwise(F.lit(0))
    offset = sign * (
        F.coalesce(group(5).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(group(6).try_cast("int"), F.lit(0)) * 60
    )
    seconds = F.unix_seconds(whole) - offset
    fraction = F.coalesce(F.rpad(F.substring(group(3), 1, 9), 9, "0").try_cast("bigint"), F.lit(0))
    inside = seconds.between(-9_223_372_036, 9_223_372_035)
    return F.when(inside, seconds * F.lit(1_000_000_000) + fraction)
