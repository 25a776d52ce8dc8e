"""Incremental parsing of growing logs with keyed state.

Input lines carry ``(home, path, line_no)`` with dense line numbers, as from a
log topic keyed by path or from immutable segment files. Segments may arrive
in any order, so lines beyond a hole wait in state until the hole is filled:
file order, not event time, decides what repeats what. The state of a file is
what the batch operators carry between blocks, so the stream's events equal
those of a cold scan.

One micro-batch's lines of a file are small; a hot file is bounded by the
batch's intake limit, not by the length of its history.
"""

from __future__ import annotations

import json

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import tallyspark
from tallyspark.fixed_values import U64_MAX

# Ship the processors with the plan: workers need no copy of the package.
cloudpickle.register_pickle_by_value(tallyspark)

SPILL_LINES = 50_000
CHUNK_LINES = 256
TOTALS = ("input", "cached_input", "output", "total")
LINE_COLUMNS = (
    "line_no", "ts_nanos", "model_set", "sets_tier", "tier_set_kind", "tier_set_text", "is_token", "source", "sig",
    "capped", *[f"t_{n}" for n in TOTALS], *[f"l_{n}" for n in TOTALS], "has_total", "has_last",
)
OUTPUT = T.StructType(
    [
        T.StructField("home", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("ts_nanos", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("tier_kind", T.StringType()),
        T.StructField("tier_text", T.StringType()),
        T.StructField("is_duplicate", T.BooleanType()),
        T.StructField("is_stale", T.BooleanType()),
        T.StructField("overflow", T.BooleanType()),
        *[
            T.StructField(n, T.DecimalType(20, 0))
            for n in ("delta_total", "delta_uncached", "delta_cached", "delta_output")
        ],
    ]
)
# Counters travel as text: state rows and Arrow have no unsigned 64-bit type.
STATE = T.StructType(
    [
        T.StructField("next_line", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("tier_kind", T.StringType()),
        T.StructField("tier_text", T.StringType()),
        T.StructField("has_previous", T.BooleanType()),
        T.StructField("previous_sig", T.StringType()),
        T.StructField("previous_model", T.StringType()),
        T.StructField("previous_capped", T.BooleanType()),
        T.StructField("high_seen", T.BooleanType()),
        *[T.StructField(f"high_{n}", T.StringType()) for n in TOTALS],
    ]
)
PEAK = T.StructType(
    [
        T.StructField("sig", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("effective", T.StringType()),
    ]
)
SOURCE_KEY = T.StructType([T.StructField("source", T.StringType())])
CHUNK_KEY = T.StructType([T.StructField("chunk", T.LongType())])
CHUNK = T.StructType([T.StructField("lines", T.StringType())])


def stream_lines(lines: DataFrame) -> DataFrame:
    """Flatten parsed lines for the processor; row-local, JVM-side."""
    from tallyspark.functions.counters import signature
    from tallyspark.operators.deltas import is_capped

    flat = [
        F.col(f"{side}.{name}").cast("string").alias(f"{short}_{name}")
        for side, short in (("total", "t"), ("last", "l"))
        for name in TOTALS
    ]
    return lines.select(
        F.col("home").cast("string").alias("home"), "path", "line_no", "ts_nanos", "model_set", "sets_tier",
        "tier_set_kind", "tier_set_text", "is_token", "source", signature(F.col("total"), F.col("last")).alias("sig"),
        is_capped(F.col("primary_percent"), F.col("secondary_percent")).alias("capped"), *flat,
        F.col("total").isNotNull().alias("has_total"), F.col("last").isNotNull().alias("has_last"),
    )


def _int(text) -> int | None:
    return None if text is None or text != text else int(text)


def _effective(parts: dict[str, int | None]) -> int:
    if parts["total"] is not None:
        return parts["total"]
    return min((parts["input"] or 0) + (parts["output"] or 0), U64_MAX)


class FileState:
    """Running state of one log file."""

    def __init__(self, row=None):
        names = STATE.fieldNames()
        self.values = dict(zip(names, row, strict=True)) if row is not None else dict.fromkeys(names)
        if row is None:
            self.values.update(next_line=0, has_previous=False, high_seen=False)

    def row(self) -> tuple:
        return tuple(self.values[n] for n in STATE.fieldNames())

    def settings(self, line: dict) -> None:
        if line["model_set"] is not None:
            self.values["model"] = line["model_set"]
        if line["sets_tier"]:
            self.values.update(tier_kind=line["tier_set_kind"], tier_text=line["tier_set_text"])

    def event(self, line: dict, peak: tuple | None) -> tuple[dict, tuple | None]:
        """Judge one event; returns the output fields and a new peak, if any."""
        v = self.values
        model = v["model"]
        total = {n: _int(line[f"t_{n}"]) for n in TOTALS}
        last = {n: _int(line[f"l_{n}"]) for n in TOTALS}
        level = _effective(total) if line["has_total"] else None
        alive = peak is not None and peak[1] == model
        adjacent = v["has_previous"] and v["previous_model"] == model and v["previous_sig"] == line["sig"]
        duplicate = line["has_total"] and ((alive and peak[0] == line["sig"]) or adjacent)
        stale = bool(not duplicate and line["has_last"] and line["has_total"] and alive and level <= int(peak[2]))
        overflow = line["capped"] and (v["previous_capped"] if v["has_previous"] else True)
        out = self._delta(duplicate or stale, line, total, last, level)
        out.update(is_duplicate=bool(duplicate), is_stale=stale, overflow=bool(overflow))
        raised = None
        if line["has_total"]:
            for name in TOTALS:
                best = [x for x in (_int(v[f"high_{name}"]), total[name]) if x is not None]
                v[f"high_{name}"] = str(max(best)) if best else None
            v["high_seen"] = True
            if not alive or level > int(peak[2]):
                raised = (line["sig"], model, str(level))
        v.update(has_previous=True, previous_sig=line["sig"], previous_model=model, previous_capped=bool(line["capped"]))
        return out, raised

    def _delta(self, nothing, line, total, last, level) -> dict:
        if nothing:
            values = (0, 0, 0, 0)
        elif line["has_last"]:
            cached = last["cached_input"] or 0
            values = (_effective(last), max((last["input"] or 0) - cached, 0), cached, last["output"] or 0)
        else:
            high = {n: _int(self.values[f"high_{n}"]) for n in TOTALS}
            rise = {n: max((total[n] or 0) - (high[n] or 0), 0) for n in ("input", "cached_input", "output")}
            if not self.values["high_seen"]:
                whole = level
            elif total["input"] is not None or total["output"] is not None:
                whole = min(rise["input"] + rise["output"], U64_MAX)
            else:
                whole = max(level - _effective(high), 0)
            values = (whole, max(rise["input"] - rise["cached_input"], 0), rise["cached_input"], rise["output"])
        return dict(zip(("delta_total", "delta_uncached", "delta_cached", "delta_output"), values, strict=True))


class Peaks:
    """Peak of each source of one file, read from state when first asked for."""

    def __init__(self, stored, empty: bool):
        self.stored, self.empty = stored, empty
        self.known: dict[str, tuple | None] = {}
        self.raised: set[str] = set()

    def of(self, source: str) -> tuple | None:
        if source not in self.known:
            peak = None if self.empty else self.stored.getValue((source,))
            self.known[source] = None if peak is None else tuple(peak)
        return self.known[source]

    def raise_to(self, source: str, peak: tuple) -> None:
        self.known[source] = peak
        self.raised.add(source)

    def keep(self) -> None:
        for source in self.raised:
            self.stored.updateValue((source,), self.known[source])


class Waiting:
    """Lines of one file beyond a hole.

    In state they are packed by ``CHUNK_LINES`` numbers: a batch reads and writes
    each chunk it touches once, however many lines that holds.
    """

    def __init__(self, stored, empty: bool):
        self.stored, self.empty = stored, empty
        self.chunks: dict[int, dict[int, tuple]] = {}
        self.merged: dict[int, bool] = {}  # chunks with their stored lines; does state hold any?
        self.count = 0

    def add(self, line: tuple) -> None:
        self.chunks.setdefault(line[0] // CHUNK_LINES, {})[line[0]] = line
        self.count += 1

    def take(self, number: int) -> tuple | None:
        at = number // CHUNK_LINES
        self._merge(at)
        return self.chunks[at].pop(number, None)

    def _merge(self, at: int) -> None:
        if at not in self.merged:
            packed = None if self.empty else self.stored.getValue((at,))
            lines = {} if packed is None else {line[0]: tuple(line) for line in json.loads(packed[0])}
            self.chunks[at] = lines | self.chunks.get(at, {})
            self.merged[at] = packed is not None

    def set_aside(self, next_line: int) -> None:
        """Move to state what is still ahead of ``next_line``."""
        written = False
        for at in list(self.chunks):
            self._merge(at)
            left = [line for number, line in self.chunks[at].items() if number >= next_line]
            if left:
                self.stored.updateValue((at,), (json.dumps(left, default=lambda value: value.item()),))
                written = True
            elif self.merged[at]:
                self.stored.removeKey((at,))
        self.empty = self.empty and not written
        self.chunks, self.merged, self.count = {}, {}, 0


class LogParser(StatefulProcessor):
    """Emits the token events of a file as its lines become contiguous."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", STATE)
        self.peaks = handle.getMapState("peaks", SOURCE_KEY, PEAK)
        self.waiting = handle.getMapState("waiting", CHUNK_KEY, CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.file.get()
        state, peaks = FileState(known), Peaks(self.peaks, known is None)
        early = Waiting(self.waiting, known is None)
        for frame in rows:
            found = []
            for line in _lines_of(frame):
                # Redelivered lines are behind the counter and drop out here.
                if line[0] == state.values["next_line"]:
                    found += self._advance(key, state, line, peaks, early)
                elif line[0] > state.values["next_line"]:
                    early.add(line)
            if early.count > SPILL_LINES:
                early.set_aside(state.values["next_line"])
            if found:
                yield pd.DataFrame(found, columns=OUTPUT.fieldNames())
        early.set_aside(state.values["next_line"])
        peaks.keep()
        self.file.update(state.row())

    def _advance(self, key, state: FileState, line: tuple | None, peaks: Peaks, early: Waiting) -> list[tuple]:
        """Take ``line`` and whatever waiting lines it makes contiguous."""
        found = []
        while line is not None:
            values = dict(zip(LINE_COLUMNS, line, strict=True))
            state.settings(values)
            if values["is_token"]:
                found.append(self._event(key, state, values, peaks))
            at = state.values["next_line"] = state.values["next_line"] + 1
            line = early.take(at)
        return found

    def _event(self, key, state: FileState, line: dict, peaks: Peaks) -> tuple:
        source = "" if line["source"] is None else "=" + line["source"]
        out, raised = state.event(line, peaks.of(source))
        if raised is not None:
            peaks.raise_to(source, raised)
        v = state.values
        stamp = line["ts_nanos"]
        return (
            key[0], key[1], int(line["line_no"]), None if stamp is None else int(stamp), v["model"], v["tier_kind"],
            v["tier_text"], out["is_duplicate"], out["is_stale"], out["overflow"],
            *[Decimal(out[n]) for n in ("delta_total", "delta_uncached", "delta_cached", "delta_output")],
        )

    def close(self) -> None:
        pass


def _lines_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows in line order as plain values; absent ones are None."""
    columns = [[None if v is None or v != v else v for v in frame[c].tolist()] for c in LINE_COLUMNS]
    columns[0] = [int(v) for v in columns[0]]
    return sorted(zip(*columns, strict=True), key=lambda line: line[0])


def process_lines(flat: DataFrame) -> DataFrame:
    """Token events of a stream of flat lines (see ``stream_lines``)."""
    return flat.groupBy("home", "path").transformWithStateInPandas(
        statefulProcessor=LogParser(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def parse_stream(lines: DataFrame) -> DataFrame:
    """Streaming counterpart of ``operators.timeline.token_events``.

    Needs the RocksDB state store (``configure_streaming``).
    """
    return process_lines(stream_lines(lines))


def configure_streaming(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
