"""Stored result tables with a schema version.

A run continues from what the last one stored. Tables written by another
version of the rules are not patched: they read as empty and are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_VERSION = 1


def save_table(df: DataFrame, root: str, name: str, version: int = TABLE_VERSION) -> None:
    """Replace this version's table; tables of other versions stay aside.

    The write goes through Spark's commit, so readers see the old table or the
    new one.
    """
    (
        df.withColumn("schema_version", F.lit(version))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("schema_version")
        .parquet(f"{root}/{name}")
    )


def load_table(spark: SparkSession, root: str, name: str, schema: T.StructType, version: int = TABLE_VERSION) -> DataFrame:
    """The rows of this version, or an empty table of ``schema``."""
    full = T.StructType([*schema.fields, T.StructField("schema_version", T.IntegerType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(full).parquet(f"{root}/{name}").where(F.col("schema_version") == version).select(*schema.fieldNames())
