"""What the operators share: tables, the shared folder, labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import scratch_folder

#: Spark's setting that a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MOST_BITS = 1 << 28  #: bits of a bitmap of ids, at most; with more than a sixteenth of that in ids, more others pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage for results that several later steps read; a lost
    executor costs a re-read.
    """
    spark = df.sparkSession
    target = scratch_folder(spark, what)
    # The written table is all that is read again: the shuffle files behind it may go with the query.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(target)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(target)


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, by: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows for each value of ``by``, in order of the key's hash.

    One top-k over all values: map tasks send at most ``rows`` of each on. The
    values of ``by`` must be few (classes, languages).
    """
    order = Window.partitionBy(*by).orderBy(F.xxhash64(key), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).drop("_rank")


def member_bits(ids: DataFrame, column: str) -> Broadcast[np.ndarray]:
    """A bitmap of hashed ids, 16 bits each, in which every id has two, at its lower and its upper half."""
    spark = ids.sparkSession
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * ids.count() - 1).bit_length()))
    places = F.array(*[F.shiftrightunsigned(column, half).bitwiseAND(F.lit(bits - 1)) for half in (0, 32)])
    places = ids.select(F.explode(places).alias("at"))
    maps = places.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for row in maps.collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out.reshape(-1))


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in the bitmap; about one in 70 of the others is too."""
    out = np.ones(len(hashes), bool)
    for half in (0, 32):
        at = hashes.view(np.uint64) >> np.uint64(half) & np.uint64(len(bits) * 8 - 1)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
