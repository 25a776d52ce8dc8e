"""Reporting windows over a stream of token events.

The day restarts at local midnight; the day is part of the key, so a new one
starts from zero and old values stay what they were.

The boundary of a quota period is often known only after events of the period
have arrived, and it may move. So the stream keeps sums per account and second,
and the boundary, which is a whole second, is applied when the sums are read:
events that came before their boundary count as they do in batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators.quota import NANOS
from tallyspark.operators.windows import local_date

SUMS = ("tokens", "overflow_tokens")


def _sums() -> list[Column]:
    plan = F.sum(F.when(~F.col("overflow"), F.col("delta_total")).otherwise(F.lit(0)))
    beyond = F.sum(F.when(F.col("overflow"), F.col("delta_total")).otherwise(F.lit(0)))
    return [plan.alias("tokens"), beyond.alias("overflow_tokens")]


def daily_usage(events: DataFrame, tz: str) -> DataFrame:
    """Tokens per account and local day; run in update mode."""
    return (
        events.where(F.col("ts_nanos").isNotNull())
        .groupBy("home", local_date(F.col("ts_nanos"), tz).alias("day"))
        .agg(*_sums())
    )


def usage_slices(events: DataFrame) -> DataFrame:
    """Tokens per account and second."""
    second = F.expr(f"div(ts_nanos, {NANOS})")
    return events.where(F.col("ts_nanos").isNotNull()).groupBy("home", second.alias("second")).agg(*_sums())


def cut_periods(slices: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Tokens per account since its boundary (``home, period_start_nanos``)."""
    current = boundaries.where(F.col("period_start_nanos").isNotNull())
    inside = slices.join(current, "home").where(F.col("second") * NANOS >= F.col("period_start_nanos"))
    return inside.groupBy("home", "period_start_nanos").agg(*[F.sum(n).alias(n) for n in SUMS])


def period_usage(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Tokens per account and quota period, in batch."""
    return cut_periods(usage_slices(events), boundaries)


def keep_slices(events: DataFrame, folder: str) -> DataStreamWriter:
    """Add each micro-batch's slices to a table of runs.

    A run holds the sums of some batches in a row. Two runs of as many batches
    are merged into one, so n batches are log2(n) runs, and a slice that many
    batches touch is summed up as it ages. A merged run counts once it is
    complete; what it replaces goes with the next batch, after readers of the
    older listing. A batch that is run again finds itself stored.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        store = _Runs(batch.sparkSession, f"{folder}/slices")
        runs = store.live(clean=True)
        if any(a <= number <= b for a, b in runs):
            return
        store.write(usage_slices(batch), number, number)
        runs.append((number, number))
        while len(runs) > 1 and runs[-1][1] - runs[-1][0] == runs[-2][1] - runs[-2][0]:
            (a, _), (_, b) = runs[-2:]
            store.write(_merged(store.read(runs[-2:])), a, b)
            runs[-2:] = [(a, b)]

    return events.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{folder}/progress")


def kept_slices(spark: SparkSession, folder: str) -> DataFrame:
    """What ``keep_slices`` has stored; ``cut_periods`` turns it into periods."""
    store = _Runs(spark, f"{folder}/slices")
    return _merged(store.read(store.live()))


def _merged(slices: DataFrame) -> DataFrame:
    return slices.groupBy("home", "second").agg(*[F.sum(n).alias(n) for n in SUMS])


class _Runs:
    """Folders ``<first batch>-<last batch>``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def live(self, clean: bool = False) -> list[tuple[int, int]]:
        """Complete runs that no longer one covers, oldest first; ``clean``: the others go."""
        done = self.fs.globStatus(self.Path(f"{self.folder}/*/_SUCCESS")) or []
        runs = [tuple(map(int, s.getPath().getParent().getName().split("-"))) for s in done]
        live: list[tuple[int, int]] = []
        for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
            if not live or b > live[-1][1]:
                live.append((a, b))
            elif clean:
                self.fs.delete(self.Path(f"{self.folder}/{a}-{b}"), True)
        return live

    def write(self, slices: DataFrame, a: int, b: int) -> None:
        slices.write.mode("overwrite").parquet(f"{self.folder}/{a}-{b}")

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{a}-{b}" for a, b in runs])
