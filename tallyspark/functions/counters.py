"""Token-counter arithmetic: saturating, NULL-aware, JVM-side only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.fixed_values import COUNTER_FIELDS, SHORT_CONTEXT_LIMIT, TIER_ALIASES, U64_MAX

WIDE = T.DecimalType(20, 0)
NARROW = T.LongType()


def counter_struct_type(wide: bool) -> T.StructType:
    kind = WIDE if wide else NARROW
    return T.StructType([T.StructField(name, kind) for name in COUNTER_FIELDS])


class CounterMath:
    """Unsigned 64-bit arithmetic on DECIMAL(20,0), or plain BIGINT when the
    source guarantees values that cannot overflow (half the row width and no
    BigDecimal in the hot path)."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.sql_type = "decimal(20,0)" if wide else "bigint"

    @classmethod
    def of(cls, df: DataFrame, column: str = "total") -> "CounterMath":
        """The arithmetic for a counter column, or a struct of counters."""
        kind = df.schema[column].dataType
        if isinstance(kind, T.StructType):
            kind = kind["input"].dataType
        return cls(isinstance(kind, T.DecimalType))

    def zero(self) -> Column:
        return F.lit(0).cast(self.sql_type)

    def clamp(self, value: Column) -> Column:
        if not self.wide:
            return value.cast(self.sql_type)
        # Not least(): it would turn an unknown value into the largest one.
        top = F.lit(str(U64_MAX)).cast("decimal(38,0)")
        return F.when(value > top, top).otherwise(value).cast(self.sql_type)

    def or_zero(self, value: Column) -> Column:
        return F.coalesce(value, self.zero())

    def add(self, left: Column, right: Column) -> Column:
        return self.clamp(left + right)

    def sub(self, left: Column, right: Column) -> Column:
        return F.greatest(left - right, self.zero()).cast(self.sql_type)

    def sum(self, value: Column) -> Column:
        """Aggregate: saturating sum."""
        return self.clamp(F.sum(value.cast("decimal(20,0)") if self.wide else value))

    def effective(self, counters: Column) -> Column:
        """The reported total, or input + output; NULL only for NULL counters."""
        both = self.add(
            self.or_zero(counters.getField("input")), self.or_zero(counters.getField("output"))
        )
        return F.when(counters.isNotNull(), F.coalesce(counters.getField("total"), both))


def has_value(counters: Column) -> Column:
    """A counters object that only carries cache writes counts as absent."""
    names = [name for name in COUNTER_FIELDS if name != "cache_write_input"]
    return reduce(lambda a, b: a | b, [counters.getField(name).isNotNull() for name in names])


def signature(total: Column, last: Column) -> Column:
    """Equality key of a snapshot: all twelve counters, NULL marked.

    NULL when both counter sets are absent: such a record is not an event.
    """
    parts = [
        F.coalesce(side.getField(name).cast("string"), F.lit("-"))
        for side in (total, last)
        for name in COUNTER_FIELDS
    ]
    return F.when(total.isNotNull() | last.isNotNull(), F.concat_ws("|", *parts))


def context_band(last: Column) -> Column:
    """Band of the single request; cumulative totals never count."""
    size = last.getField("input")
    return (
        F.when(size.isNull(), F.lit("unknown"))
        .when(size <= F.lit(SHORT_CONTEXT_LIMIT), F.lit("short"))
        .otherwise(F.lit("long"))
    )


def details_missing(total: Column, last: Column) -> Column:
    used = F.when(last.isNotNull(), last).otherwise(total)
    return used.getField("input").isNull() | used.getField("output").isNull()


def tier_kind(text: Column) -> Column:
    """Normalised tier of a tier text; NULL stays NULL, other texts are unknown."""
    known = F.create_map(*[F.lit(part) for pair in TIER_ALIASES.items() for part in pair])
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(known, text), F.lit("unknown")))
