"""A training-corpus pipeline: one stage after the other over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. What a stage returns is written as Parquet in the shared
folder and read again as the next one's documents.

In every stage an empty table gives no rows, a null text counts as an empty one,
rows without doc_id are judged by their text alone where the stage compares
texts with test items or scores them and stay where it compares documents, and
further columns of any name come along (but for the last stage, which returns
places). Rows that repeat a doc_id with other texts are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.contamination import find_leaks
from tallyspark.llm.jaccard import jaccard_components, with_set_key
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.quality import fit_quality, score_quality
from tallyspark.llm.shared import remainder, table, written
from tallyspark.llm.substrings import dedup_substrings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts: a score of 0.5 or more, equal texts alike."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit_quality(docs.select("doc_id", "text"), labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score_quality(docs, model).where(F.col("score") >= 0.5).select("document.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five words, similarity 0.8.

    Rows that share a doc_id are told apart by their shingle sets: each stays
    unless it is in a group with a smaller doc_id, and of several in one group
    the one whose text and columns sort first by hash. Empty texts are no group.
    """
    groups = written(jaccard_components(docs.select("doc_id", "text"), words=5, percent=80), "groups")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = written(repeated, "repeated")
    others = groups.where("component_id <> doc_id").select("doc_id")
    alone = docs.join(repeated, "doc_id", "left_anti").join(others, "doc_id", "left_anti").select(docs.columns)
    # The few ids that several rows share, by their sets.
    place = [F.col("doc_id").cast("long").alias("id"), F.coalesce("set_key", F.lit(0)).alias("set")]
    placed = groups.join(repeated, "doc_id", "left_semi").select(*place, "component_id", F.coalesce("group_key", F.lit(0)).alias("group")).distinct()
    keyed = with_set_key(docs.join(repeated, "doc_id", "left_semi").select(docs.columns), words=5)
    keyed = keyed.select("document", F.col("document.doc_id").cast("long").alias("id"), F.coalesce("set_key", F.lit(0)).alias("set"))
    rows = keyed.join(placed, ["id", "set"]).where("component_id = id")
    first = F.struct(F.xxhash64("document.text"), F.to_json("document"))
    return alone.unionByName(rows.groupBy("id", "group").agg(F.min_by("document", first).alias("document")).select("document.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; those with nothing left go.

    Of equal passages the one in the smallest doc_id stays; rows of one doc_id do not touch each other.
    """
    cut = dedup_substrings(docs, window=13).where("n_removed = 0 OR kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("document.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("document.n_chars"))}
    return cut.select(*(new.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an exact or edited copy of a benchmark item; repeated rows fare alike."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: the training sequences. Rows without words have no bin."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_group),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: Trained and packed stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
