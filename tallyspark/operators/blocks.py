"""Prefix scans that never put one whole file, account or thread in one task.

A running value over an ordered group is computed in two levels. Rows fall
into blocks of consecutive positions; windows run inside ``(group, block)``,
so no task holds more than one block of a group. Each block is summarised to
one row, the summaries are scanned per group (rows / block size of them) and
the value carried into each block is joined back on ``(group, block)``. A file
holding a third of a table is therefore spread over as many tasks as it has
blocks, and the answer is the same as that of a single window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyspark.session import settle

BLOCK_ROWS = 1 << 20


def with_blocks(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block``: the run of ``block_rows`` line numbers a row falls in."""
    return df.withColumn("block", F.expr(f"line_no div {int(block_rows)}"))


def within_block(keys: Sequence[str], order: Sequence[str] = ("line_no",)) -> WindowSpec:
    return Window.partitionBy(*keys, "block").orderBy(*order)


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_into_blocks(
    summary: DataFrame, keys: Sequence[str], carried: dict[str, Callable[[WindowSpec], Column]]
) -> DataFrame:
    """Scan block summaries; each ``carried`` entry sees the earlier blocks only.

    First blocks have nothing carried into them and are left out, so a table
    of one-block files joins with an empty relation. Join with ``left``.
    """
    order = Window.partitionBy(*keys).orderBy("block")
    return (
        summary.select(
            *keys,
            "block",
            F.lag("block").over(order).alias("_earlier"),
            *[make(before(order)).alias(name) for name, make in carried.items()],
        )
        .where(F.col("_earlier").isNotNull())
        .drop("_earlier")
    )


def continued_blocks(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of groups with more than one block: only there does anything
    have to be carried."""
    blocks = events.select(*keys, "block").distinct()
    counted = blocks.select(*keys, "block", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    return counted.where(F.col("_n") > 1).drop("_n")


def last_known(column: str) -> Callable[[WindowSpec], Column]:
    return lambda spec: F.last(column, ignorenulls=True).over(spec)


def highest(column: str) -> Callable[[WindowSpec], Column]:
    return lambda spec: F.max(column).over(spec)


def added(column: str) -> Callable[[WindowSpec], Column]:
    return lambda spec: F.coalesce(F.sum(column).over(spec), F.lit(0)).cast("bigint")


def spread_over_blocks(files: DataFrame, events: DataFrame, keys: Sequence[str] = ("home", "path")) -> DataFrame:
    """One row per file and block it has events in, so file attributes join
    to events on ``(file, block)``: the big side stays evenly spread and
    nothing is broadcast. The distinct blocks are found map-side first."""
    return events.select(*keys, "block").distinct().join(files, list(keys))


def dense_positions(events: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """Number the rows of every group from 0 in line order."""
    counts = events.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = carry_into_blocks(counts, keys, {"_offset": added("_n")})
    local = events.withColumn("_rn", F.row_number().over(within_block(keys)))
    return (
        local.join(offsets, [*keys, "block"], "left")
        .withColumn(name, (F.coalesce("_offset", F.lit(0)) + F.col("_rn") - 1).cast("bigint"))
        .drop("_offset", "_rn")
    )


def fold_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    step: dict[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """Per group, sum ``step(previous row, row)`` over neighbouring rows.

    For orders without line numbers (times over many files). A range exchange
    on the full order cuts even a single hot group into even slices; a slice
    keeps its own sum, first and last row, and only those are combined across
    slices. Returns ``keys`` and one column per ``step`` entry.
    """
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *payload])])
    sliced = (
        df.select(*dict.fromkeys([*keys, *order, *payload]))
        .repartitionByRange(*keys, *order)
        .withColumn("block", F.spark_partition_id())
        .withColumn("_row", row)
    )
    previous = F.lag("_row").over(Window.partitionBy(*keys, "block").orderBy(*order))
    inside = sliced.withColumn("_prev", previous)
    slices = inside.groupBy(*keys, "block").agg(
        F.min("_row").alias("_first"),
        F.max("_row").alias("_last"),
        *[
            F.sum(F.when(F.col("_prev").isNotNull(), make(F.col("_prev"), F.col("_row")))).alias(n)
            for n, make in step.items()
        ],
    )
    joined = slices.withColumn(
        "_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("block"))
    )
    return joined.groupBy(*keys).agg(
        *[
            F.sum(
                F.coalesce(F.col(n), F.lit(0))
                + F.coalesce(
                    F.when(F.col("_prev").isNotNull(), make(F.col("_prev"), F.col("_first"))),
                    F.lit(0),
                )
            ).alias(n)
            for n, make in step.items()
        ]
    )


#: Rows of one key that a task may well take; keys with more are spread.
HOT_ROWS = 1 << 20
#: Facts of fewer bytes, by the plan's own estimate, hold no such key.
COLD_BYTES = 64 << 20
#: Counters of the frequency sketch, and how many of the most frequent keys are looked at.
SKETCH_KEYS, SKETCH_TOP = 10_000, 1_000


def hot_keys(facts: DataFrame, on: Sequence[str]) -> dict[int, int]:
    """Hashes of keys with more than ``HOT_ROWS`` rows, and over how many copies they are spread.

    One pass of a bounded frequency sketch, merged map-side; none for small facts.
    """
    if int(facts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < COLD_BYTES:
        return {}
    top = facts.agg(F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {SKETCH_TOP}, {SKETCH_KEYS})").alias("top")).first()["top"]
    return {t["item"]: -(-t["count"] // HOT_ROWS) for t in top if t["count"] > HOT_ROWS}


def join_dimension(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "left",
) -> DataFrame:
    """Join a per-key dimension to facts whose keys may be hot.

    Only keys that a sketch of the facts finds hot are spread: their dimension
    rows are repeated, a copy for every ``HOT_ROWS`` rows, and their facts pick
    one by the hash of ``spread_by``. All other keys join as they are, so the
    repeats are fewer than the facts divided by ``HOT_ROWS``. Whether the
    dimension is broadcast is left to the run-time size check of AQE.
    """
    hot = hot_keys(facts, on)
    if not hot:
        return facts.join(dim, list(on), how)
    copies = F.create_map(*[F.lit(x).cast(t) for key, n in hot.items() for x, t in ((key, "bigint"), (n, "int"))])
    copies = F.coalesce(F.try_element_at(copies, F.xxhash64(*on)), F.lit(1))
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), copies.cast("bigint")).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted_facts.join(salted_dim, [*on, "_salt"], how).drop("_salt")


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted by ``keys`` and ``order`` and cut into even slices, whose
    number is kept in ``block``; a hot key gets as many slices as it needs.

    The table is written once, because several branches have to agree on where
    the range exchange cut it.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return settle(ranged.withColumn("block", F.spark_partition_id().cast("bigint")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Add running values over ``keys`` in ``order`` to rows with ``block``.

    ``columns`` maps a name to ``(how, value, with_current)``, ``how`` one of
    ``last`` (not NULL), ``max``, ``sum``.
    """
    inner = Window.partitionBy(*keys, "block").orderBy(*order)
    aggregate = {
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order))),
        "max": F.max,
        "sum": F.sum,
    }
    over = {
        "last": lambda v, w: F.last(v, ignorenulls=True).over(w),
        "max": lambda v, w: F.max(v).over(w),
        "sum": lambda v, w: F.sum(v).over(w),
    }
    zero = F.lit(0)
    join = {
        "last": lambda local, carried: F.coalesce(local, carried),
        "max": lambda local, carried: F.greatest(local, carried),
        "sum": lambda local, carried: F.coalesce(local, zero) + F.coalesce(carried, zero),
    }
    ends = df.groupBy(*keys, "block").agg(
        *[aggregate[how](value).alias(f"_end_{n}") for n, (how, value, _) in columns.items()]
    )
    carried = carry_into_blocks(
        ends, keys, {f"_in_{n}": (lambda w, n=n, how=how: over[how](F.col(f"_end_{n}"), w)) for n, (how, _, _) in columns.items()}
    )
    local = df.select(
        *df.columns,
        *[over[how](v, upto(inner) if now else before(inner)).alias(f"_own_{n}") for n, (how, v, now) in columns.items()],
    )
    return local.join(carried, [*keys, "block"], "left").select(
        *df.columns,
        *[join[how](F.col(f"_own_{n}"), F.col(f"_in_{n}")).alias(n) for n, (how, _, _) in columns.items()],
    )
