"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the operators rely on.

    ``session.timeZone`` only affects how timestamps are rendered: every
    operator takes its own ``tz`` and stores event times as epoch nanoseconds.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows already spread by (file, block) stay where they are when a join adds
    # further keys; a block bounds how much one task can receive.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Methods beyond 8000 bytes of bytecode are never compiled by the JIT; let
    # Spark split such wide projections instead of running them interpreted.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Logs written by other tools may repeat a JSON key; keep the last value.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate results, shared by driver and executors.

    It is the one the cluster names in ``spark.checkpoint.dir``. A session that
    runs in one process on a local master may use the JVM's temp folder; on a
    cluster that would be another folder on each machine, so there an unset
    folder is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not is_one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark._jvm.System.getProperty('java.io.tmpdir')}/tallyspark-{spark.sparkContext.applicationId}"
    spark.sparkContext.setCheckpointDir(named)
    return named


def is_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


#: What this process has written and may discard.
_written: set[str] = set()


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for intermediate results; ``discard_scratch`` removes it."""
    target = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.add(target)
    return target


def discard_scratch(spark: SparkSession) -> int:
    """Delete all intermediate results of this process, once the results that
    read them are stored; returns how many folders went."""
    return _discard(spark, set(_written))


def _discard(spark: SparkSession, targets: set[str]) -> int:
    gone = 0
    for target in sorted(targets):
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    _written.difference_update(targets)
    return gone


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate results that are written inside go at the end, as a stream's batches must not pile them up."""
    before = set(_written)
    try:
        yield
    finally:
        _discard(spark, _written - before)


def write_settled(df: DataFrame) -> str:
    """Write ``df`` as Parquet in the shared folder; returns where."""
    target = scratch_folder(df.sparkSession, "settled")
    df.write.parquet(target)
    return target


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back.

    Used where a result feeds several branches: the plan stays small, the
    work runs once, later branches read only the columns they need, and a
    lost executor costs a re-read instead of a recomputation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_settled(df))
