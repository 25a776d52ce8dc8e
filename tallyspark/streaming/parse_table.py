"""Incremental parsing of growing logs over tables of carried values.

What the block scans of ``operators`` carry from block to block is kept per file
when a micro-batch ends: the settings in force, the last event, high-water marks
and the peak of each source. The next batch's scans start from there, as if from
a block before the first. All of it is columns: a hot file is spread over its
blocks like in batch, and no row goes through Python.

Lines of a file come in order, batch by batch, as a source by bytes delivers
them; lines that are delivered again are behind the last line and drop out. Only
if a file has such lines are a batch's lines compared with the last ones and
written anew. Of a line, only what parsing or the wanted columns need is stored.
Segments that may overtake each other are for ``parse_state``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators.blocks import spread_over_blocks
from tallyspark.operators.carry import FILE
from tallyspark.operators.deltas import HIGH_WATER, timeline_state, token_timeline
from tallyspark.operators.timeline import flat_events
from tallyspark.session import passing_scratch, settle
from tallyspark.sources.buckets import KEEP_SECONDS, Buckets


#: What parsing reads of a line.
LINE = (
    *FILE, "block", "line_no", "is_token", "model_set", "sets_tier", "tier_set_kind", "tier_set_text", "source", "total", "last",
    "primary_percent", "secondary_percent",
)
#: What the timeline reads of an event, beside the columns that begin with an underscore.
EVENT = (*FILE, "block", "line_no", "model", "sig", "capped")


@dataclass(frozen=True)
class ParseRules:
    buckets: int = 64
    keep_seconds: float = KEEP_SECONDS  #: how long replaced state files stay


def parse_batch(
    lines: DataFrame, carry: DataFrame | None, peaks: DataFrame | None, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Token events of new lines (a table with ``block``), and the carried values and peaks after them.

    ``carry``: per file ``last_line, model, tier, prev, seen, high_*``.
    ``columns``: those of the events that are wanted, all if not given.
    """
    if carry is not None:
        first = lines.groupBy(*FILE).agg(F.min("line_no").alias("_first"))
        again = settle(carry.join(first, list(FILE)).where("_first <= last_line").select(*FILE, "last_line"))
        if not again.isEmpty():
            known = spread_over_blocks(again, lines)
            lines = settle(lines.join(known, [*FILE, "block"], "left").where("last_line IS NULL OR line_no > last_line").drop("last_line"))
    flat = flat_events(lines, FILE, carry)
    if columns is not None:
        flat = flat.select(*[c for c in flat.columns if c.startswith("_") or c in EVENT or c in columns])
    flat = settle(flat)
    events = token_timeline(flat, FILE, carry, peaks)
    ends, new_peaks = timeline_state(flat, carry, peaks)
    tier = F.struct(F.col("tier_set_kind").alias("kind"), F.col("tier_set_text").alias("text"))
    set_ = lines.groupBy(*FILE).agg(
        F.max("line_no").alias("_line"),
        F.max_by("model_set", F.when(F.col("model_set").isNotNull(), F.col("line_no"))).alias("_model"),
        F.max_by(tier, F.when(F.col("sets_tier"), F.col("line_no"))).alias("_tier"),
    )
    if carry is None:
        settings = set_.select(*FILE, F.col("_line").alias("last_line"), F.col("_model").alias("model"), F.col("_tier").alias("tier"))
    else:
        both = set_.join(carry.select(*FILE, "last_line", "model", "tier"), list(FILE), "full_outer")
        settings = both.select(
            *FILE, F.greatest("_line", "last_line").alias("last_line"), F.coalesce("_model", "model").alias("model"), F.coalesce("_tier", "tier").alias("tier")
        )
    new_carry = settings.join(ends, list(FILE), "left").select(*FILE, "last_line", "model", "tier", "prev", "seen", *[f"high_{n}" for n in HIGH_WATER])
    return events, new_carry, new_peaks


def parse_lines(lines: DataFrame, columns: list[str], folder: str, rules: ParseRules = ParseRules()) -> DataStreamWriter:
    """Follow a stream of parsed lines; ``columns`` of their events go to ``folder/events``, see ``events_of``.

    A batch that is run again starts from the state before it and replaces its
    own events.
    """
    # A batch is read as it is written: what it does not name is left out before.
    needed = lines.select(*[c for c in lines.columns if c in LINE or c in columns])

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Buckets(spark, f"{folder}/state", ("carry", "peaks"), FILE, rules.buckets)
        before = store.newest(before=number)
        with passing_scratch(spark):
            arrived = settle(batch)
            changed = store.numbers_of(arrived)
            if not changed:
                return
            carry, peaks = store.read(before, "carry", changed), store.read(before, "peaks", changed)
            events, new_carry, new_peaks = parse_batch(arrived, carry, peaks, columns)
            events.select(*columns).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
            # Files of these buckets that no line came for keep what they had.
            store.write("carry", number, new_carry)
            store.write("peaks", number, new_peaks)
            store.commit(before, number, changed)
            store.forget(rules.keep_seconds)

    return needed.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{folder}/progress")


def events_of(spark, folder: str) -> DataFrame:
    """All events so far, each once, with the batch that brought it."""
    return spark.read.option("basePath", f"{folder}/events").parquet(f"{folder}/events")
