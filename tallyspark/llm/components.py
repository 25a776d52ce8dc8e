"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link; ``links``: (a, b) of long.

    Each round every node joins its neighbour of the smallest hash, and links
    are drawn anew between the joined groups; the number of groups that still
    have links at least halves on average, so rounds grow with its logarithm.
    A node with very many links is only ever aggregated, never gathered.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    both = edges.union(edges.select("b", "a"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        moved = written(best.select("a", F.least("m", order("a"))["id"].alias("to")), "moves")
        labels = written(
            labels.join(moved, labels["comp"] == moved["a"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels"
        )
        left, right = moved.select("a", F.col("to").alias("x")), moved.select(F.col("a").alias("b"), F.col("to").alias("y"))
        drawn = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels
