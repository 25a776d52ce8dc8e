"""Alerts while looks at accounts arrive.

A home's state is one row: what ``operators.watching`` carries from look to
look. A micro-batch reads the state of the homes it touches, goes on from
there, and writes the hash buckets of these homes anew; the quota periods that
have had their overflow alert are kept alike. Nothing of a batch is read again,
so the cost of a batch follows the batch, and no look is ever too old to count.

State survives restarts, a hot account is spread like any other, and a batch
that is run again starts from the state before it and replaces its own rows.
Within a batch looks count in the order of their times, batches in the order in
which they arrive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators.watching import alerts_in, judge_looks, state_after
from tallyspark.session import passing_scratch, settle
from tallyspark.sources.buckets import KEEP_SECONDS, Buckets


@dataclass(frozen=True)
class AlertRules:
    refresh_seconds: int
    resets: bool = True
    overflow: bool = True
    buckets: int = 64
    keep_seconds: float = KEEP_SECONDS  #: how long replaced state files stay


def watch(looks: DataFrame, rules: AlertRules, folder: str) -> DataStreamWriter:
    """Follow a stream of looks; alerts go to ``folder/alerts``, see ``alerts_of``."""

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Buckets(spark, f"{folder}/state", ("state", "fired"), ("home",), rules.buckets)
        before = store.newest(before=number)
        with passing_scratch(spark):
            arrived = settle(batch)
            if arrived.isEmpty():
                return
            changed = store.numbers_of(arrived)
            state, fired = store.read(before, "state", changed), store.read(before, "fired", changed)
            rows = settle(judge_looks(arrived, rules.refresh_seconds, state))
            found, spent = alerts_in(rows, rules.refresh_seconds, rules.resets, rules.overflow, fired)
            found.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
            after = state_after(rows)
            if state is not None:
                after = after.unionByName(state.join(arrived.select("home").distinct(), "home", "left_anti"))
            store.write("state", number, after)
            store.write("fired", number, spent if fired is None else spent.unionByName(fired))
            store.commit(before, number, changed)
            store.forget(rules.keep_seconds)

    return looks.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{folder}/progress")


def alerts_of(spark, folder: str) -> DataFrame:
    """All alerts so far, each once, with the batch that found it."""
    return spark.read.option("basePath", f"{folder}/alerts").parquet(f"{folder}/alerts")
