"""Usage per event from cumulative, repeated and stale counter snapshots.

Three pieces of history decide what an event adds:

* the event before it in the file (exact repeats, whatever the source);
* the peak snapshot of its source since the model last changed (repeats and
  stale snapshots);
* the file's component-wise high-water mark (events that carry only totals).

All three are prefix scans, run block-wise (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyspark.fixed_values import CAPPED_PERCENT
from tallyspark.functions.counters import CounterMath, signature
from tallyspark.operators.blocks import (
    before,
    carry_into_blocks,
    continued_blocks,
    highest,
    last_known,
    spread_over_blocks,
    upto,
    within_block,
)
from tallyspark.operators.carry import FILE

HIGH_WATER = ("input", "cached_input", "output", "total")
DELTAS = ("delta_total", "delta_uncached", "delta_cached", "delta_output")


def is_capped(primary: Column, secondary: Column) -> Column:
    full = F.lit(CAPPED_PERCENT)
    return F.coalesce(primary >= full, F.lit(False)) | F.coalesce(secondary >= full, F.lit(False))


def _in_source(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "block", "_source", "_has_total").orderBy("line_no")


def _with_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_run``: the model changes of the source so far in the block."""
    previous_model = F.lag(F.struct("model")).over(_in_source(keys))
    changed = previous_model.isNotNull() & ~previous_model.getField("model").eqNullSafe(F.col("model"))
    marked = rows.select(*rows.columns, changed.cast("bigint").alias("_change"))
    return marked.select(*rows.columns, F.sum("_change").over(upto(_in_source(keys))).alias("_run"))


def _numbered_runs(totals: DataFrame, keys: Sequence[str], state: DataFrame | None = None) -> DataFrame:
    """Per source and block: its first run's number, its last run's peak and model, numbered through the file.

    ``totals``: total-bearing events with ``_run``. ``state``: the peaks that
    earlier lines left; they stand as a block before the first.
    """
    by_source = [*keys, "_source"]
    blocks = totals.groupBy(*by_source, "block").agg(
        F.min(F.struct("line_no", "model")).alias("_head"),
        F.max(F.struct("line_no", "model")).alias("_tail"),
        F.max("_run").alias("_changes"),
        F.max(F.struct("_run", "_teff", "_neg_line", "sig")).alias("_peak"),
    )
    if state is not None:
        edge = F.struct(F.lit(-1).cast("bigint").alias("line_no"), "model")
        peak = F.struct(F.lit(0).cast("bigint").alias("_run"), F.col("teff").alias("_teff"), F.col("neg_line").alias("_neg_line"), "sig")
        blocks = blocks.unionByName(
            state.select(
                *by_source, F.lit(-1).cast("bigint").alias("block"), edge.alias("_head"), edge.alias("_tail"),
                F.lit(0).cast("bigint").alias("_changes"), peak.alias("_peak"),
            )
        )
    order = Window.partitionBy(*by_source).orderBy("block")
    blocks = blocks.select(
        *blocks.columns, F.lag(F.struct("_tail", "_changes")).over(order).alias("_lag")
    )
    changed = F.col("_lag").isNotNull() & ~F.col("_lag._tail.model").eqNullSafe(F.col("_head.model"))
    step = changed.cast("bigint") + F.coalesce(F.col("_lag._changes"), F.lit(0))
    blocks = blocks.select(*blocks.columns, F.sum(step).over(upto(order)).alias("_run_first"))
    run_peak = F.struct(
        (F.col("_run_first") + F.col("_changes")).alias("run"),
        F.col("_peak._teff").alias("teff"),
        F.col("_peak._neg_line").alias("neg_line"),
        F.col("_peak.sig").alias("sig"),
    )
    return blocks.select(*by_source, "block", "_run_first", run_peak.alias("_run_peak"), F.col("_tail.model").alias("_end_model"))


def _source_peaks(totals: DataFrame, keys: Sequence[str], state: DataFrame | None = None) -> DataFrame:
    """Per-source peak carried into each block.

    A peak lives while the source's model stays the same. On block level the
    runs are numbered through, so "still the same run" is an equality of run
    numbers and the carried peak is a plain running maximum.
    """
    by_source = [*keys, "_source"]
    blocks = _numbered_runs(totals, keys, state)
    order = Window.partitionBy(*by_source).orderBy("block")
    carried = blocks.select(
        *by_source, "block", "_run_first", F.max("_run_peak").over(before(order)).alias("_in")
    )
    return carried.where(F.col("_in.run") == F.col("_run_first")).select(
        *by_source,
        "block",
        F.lit(True).alias("_has_total"),
        F.struct("_in.teff", "_in.neg_line", "_in.sig").alias("_in_peak"),
    )


def flatten_events(events: DataFrame) -> DataFrame:
    """Everything an event needs of its own row, flat, so that the counter
    structs need not travel through the sorts of the timeline."""
    math = CounterMath.of(events)
    total, last = F.col("total"), F.col("last")

    def part(counters: Column, name: str) -> Column:
        return math.or_zero(counters.getField(name))

    return events.select(
        *[c for c in events.columns if c not in ("total", "last")],
        signature(total, last).alias("sig"),
        is_capped(F.col("primary_percent"), F.col("secondary_percent")).alias("capped"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
        (-F.col("line_no")).alias("_neg_line"),
        total.isNotNull().alias("_has_total"),
        last.isNotNull().alias("_has_last"),
        math.effective(total).alias("_teff"),
        *[total.getField(name).alias(f"_t_{name}") for name in HIGH_WATER],
        math.effective(last).alias("_l_total"),
        math.sub(part(last, "input"), part(last, "cached_input")).alias("_l_uncached"),
        part(last, "cached_input").alias("_l_cached"),
        part(last, "output").alias("_l_output"),
    )


def timeline_state(
    flat: DataFrame, carry: DataFrame | None, peaks: DataFrame | None, keys: Sequence[str] = FILE
) -> tuple[DataFrame, DataFrame]:
    """What events leave behind, added to what earlier ones left.

    Per file ``prev`` (the last event's model, signature and whether it was
    capped), ``seen`` and ``high_*``; per file and ``_source`` the peak of its
    last run and the run's model.
    """
    names = [f"high_{n}" for n in HIGH_WATER]
    ends = flat.groupBy(*keys).agg(
        F.max(F.struct("line_no", "model", "sig", "capped")).alias("_end"),
        F.max("_has_total").alias("seen"),
        *[F.max(f"_t_{n}").alias(f"high_{n}") for n in HIGH_WATER],
    )
    ends = ends.select(*keys, F.struct("_end.model", "_end.sig", "_end.capped").alias("prev"), "seen", *names)
    if carry is not None:
        old = carry.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in ("prev", "seen", *names)])
        ends = ends.join(old, list(keys), "full_outer")
        ends = ends.select(
            *keys, F.coalesce("prev", "_old_prev").alias("prev"), F.greatest("seen", "_old_seen").alias("seen"),
            *[F.greatest(n, f"_old_{n}").alias(n) for n in names],
        )
    runs = _numbered_runs(_with_runs(flat.where("_has_total"), keys), keys, peaks)
    last = runs.groupBy(*keys, "_source").agg(F.max("_run_peak").alias("_p"), F.max_by(F.struct("_end_model"), "block").alias("_m"))
    return ends, last.select(*keys, "_source", F.col("_m._end_model").alias("model"), "_p.teff", "_p.neg_line", "_p.sig")


def token_timeline(
    flat: DataFrame, keys: Sequence[str] = FILE, carry: DataFrame | None = None, peaks: DataFrame | None = None
) -> DataFrame:
    """Add deltas, the repeat/stale verdict and the overflow flag.

    ``carry``, ``peaks``: what earlier events left (``timeline_state``).

    ``flat``: token events as given by ``flatten_events``, preferably a table,
    with ``block, line_no, source, model``. Adds ``is_duplicate, is_stale,
    overflow, delta_total, delta_uncached, delta_cached, delta_output``.
    """
    math = CounterMath.of(flat, "_teff")
    base = flat

    in_file = within_block(keys)
    seen_before = before(in_file)
    local = base.select(
        *base.columns,
        F.lag(F.struct("model", "sig", "capped")).over(in_file).alias("_prev"),
        *[F.max(f"_t_{name}").over(seen_before).alias(f"_hw_{name}") for name in HIGH_WATER],
        F.max("_has_total").over(seen_before).alias("_hw_seen"),
    )
    local = _with_runs(local, keys)
    peak = F.max(F.struct("_run", "_teff", "_neg_line", "sig")).over(before(_in_source(keys)))
    local = local.select(*local.columns, peak.alias("_peak"))

    file_carry = carry_into_blocks(
        base.groupBy(*keys, "block").agg(
            F.max(F.struct("line_no", "model", "sig", "capped")).alias("_end"),
            F.max("_has_total").alias("_seen"),
            *[F.max(f"_t_{name}").alias(f"_m_{name}") for name in HIGH_WATER],
        ),
        keys,
        {
            "_in_prev": last_known("_end"),
            "_in_seen": highest("_seen"),
            **{f"_in_{name}": highest(f"_m_{name}") for name in HIGH_WATER},
        },
    )
    # Peaks are scanned per source over the blocks of longer files; files that
    # fit one block drop out before the sort.
    scanned = continued_blocks(base, keys)
    if peaks is not None:
        scanned = scanned.union(spread_over_blocks(peaks.select(*keys).distinct(), base, keys).select(*keys, "block")).distinct()
    longer = base.where("_has_total").join(scanned, [*keys, "block"], "left_semi")
    source_carry = _source_peaks(_with_runs(longer, keys), keys, peaks)

    joined = local.join(file_carry, [*keys, "block"], "left").join(
        source_carry, [*keys, "block", "_source", "_has_total"], "left"
    )
    if carry is not None:
        old = carry.select(*keys, F.col("prev").alias("_old_prev"), F.col("seen").alias("_old_seen"), *[F.col(f"high_{n}").alias(f"_old_{n}") for n in HIGH_WATER])
        joined = joined.join(spread_over_blocks(old, base, keys), [*keys, "block"], "left")
        end = F.struct(F.lit(-1).cast("bigint").alias("line_no"), "_old_prev.model", "_old_prev.sig", "_old_prev.capped")
        joined = joined.withColumns(
            {
                "_in_prev": F.coalesce("_in_prev", F.when(F.col("_old_prev").isNotNull(), end)),
                "_in_seen": F.greatest("_in_seen", "_old_seen"),
                **{f"_in_{n}": F.greatest(f"_in_{n}", f"_old_{n}") for n in HIGH_WATER},
            }
        )
    carried_prev = F.when(
        F.col("_in_prev").isNotNull(), F.struct("_in_prev.model", "_in_prev.sig", "_in_prev.capped")
    )
    own_peak = F.when(
        F.col("_peak._run") == F.col("_run"),
        F.struct(
            F.col("_peak._teff").alias("teff"),
            F.col("_peak._neg_line").alias("neg_line"),
            F.col("_peak.sig").alias("sig"),
        ),
    )
    combined = joined.select(
        *base.columns,
        F.coalesce(F.col("_prev"), carried_prev).alias("_prev"),
        F.greatest(own_peak, F.when(F.col("_run") == 0, F.col("_in_peak"))).alias("_peak"),
        F.coalesce(F.greatest("_hw_seen", "_in_seen"), F.lit(False)).alias("_hw_seen"),
        *[F.greatest(f"_hw_{name}", f"_in_{name}").alias(f"_hw_{name}") for name in HIGH_WATER],
    )
    return _deltas(_judge(combined), math, [c for c in base.columns if not c.startswith("_")])


def _judge(df: DataFrame) -> DataFrame:
    repeats_previous = (
        F.col("_prev").isNotNull()
        & F.col("_prev.model").eqNullSafe(F.col("model"))
        & (F.col("_prev.sig") == F.col("sig"))
    )
    repeats_peak = F.coalesce(F.col("_peak.sig") == F.col("sig"), F.lit(False))
    duplicate = F.col("_has_total") & (repeats_peak | F.coalesce(repeats_previous, F.lit(False)))
    behind = F.col("_has_last") & F.coalesce(F.col("_teff") <= F.col("_peak.teff"), F.lit(False))
    # The first event of a file stands on its own reading; later ones overflow
    # only when the reading before them was already full.
    overflow = F.col("capped") & F.coalesce(F.col("_prev.capped"), F.lit(True))
    judged = df.select(*df.columns, duplicate.alias("is_duplicate"), behind.alias("_behind"), overflow.alias("overflow"))
    return judged.select(
        *df.columns, "is_duplicate", "overflow", (F.col("_behind") & ~F.col("is_duplicate")).alias("is_stale")
    )


def _deltas(df: DataFrame, math: CounterMath, columns: Sequence[str]) -> DataFrame:
    zero = math.zero()

    def high(name: str) -> Column:
        return math.or_zero(F.col(f"_hw_{name}"))

    def rise(name: str) -> Column:
        return math.sub(math.or_zero(F.col(f"_t_{name}")), high(name))

    names_parts = F.col("_t_input").isNotNull() | F.col("_t_output").isNotNull()
    high_total = F.coalesce(F.col("_hw_total"), math.add(high("input"), high("output")))
    from_total = {
        "delta_total": F.when(~F.col("_hw_seen"), F.col("_teff"))
        .when(names_parts, math.add(rise("input"), rise("output")))
        .otherwise(math.sub(F.col("_teff"), high_total)),
        "delta_uncached": math.sub(rise("input"), rise("cached_input")),
        "delta_cached": rise("cached_input"),
        "delta_output": rise("output"),
    }
    nothing = F.col("is_duplicate") | F.col("is_stale")
    return df.select(
        *columns,
        "overflow",
        "is_duplicate",
        "is_stale",
        *[
            F.when(nothing, zero)
            .when(F.col("_has_last"), F.col(name.replace("delta", "_l")))
            .when(F.col("_has_total"), from_total[name])
            .otherwise(zero)
            .alias(name)
            for name in DELTAS
        ],
    )
