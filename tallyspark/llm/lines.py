"""Line deduplication with range-partitioned hashes and keep bitmaps.

A line's key is the line without white space at both ends, A-Z lower-cased. A
line goes if its key has at least ``least`` code points and a smaller doc_id
holds it too.

1. Every such line becomes (hash, doc_id, row, position); no text leaves here.
   A hash has 128 bits.
2. The entries are range-partitioned over the whole order (hash, doc_id, row,
   position) and sorted within partitions. As the order goes on below the hash,
   a line in a third of all documents is cut into as many even partitions as it
   needs.
3. A stream over each partition keeps one hash and the document in which it came
   first; later documents are reported. A hash that goes on from the partition
   before cannot be judged there in its first document only: those entries, and
   the last hash of each partition, are matched afterwards (a row a partition).
4. Positions of a row's lost lines become its keep bitmap: one bit a line, most
   significant first, zlib-compressed.

Nulls and edge cases: a null or empty text is one empty line. Rows without
doc_id neither lose lines nor take any from others. Rows that repeat a doc_id
are one document: they take no lines from each other. Equal lines of the first
document all stay. An empty table gives no rows. The input's columns come back
in the struct ``document``, so names cannot clash; other columns may have any
name or type.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyspark.llm.hashing import slices
from tallyspark.llm.shared import written

LEAST = 10  #: code points of a key that can be lost
ORDER = ["h1", "h2", "doc_id", "row", "pos"]
# Kinds of reported entries.
LOST, OPEN, LAST = 0, 1, 2
REPORT = "kind int, h1 long, h2 long, doc_id long, row long, pos int, n_lines int"


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows that are equal in id and text, which fare alike."""
    return F.xxhash64(doc_id, text)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), string.ascii_uppercase, string.ascii_lowercase)


def line_entries(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2, doc_id, row, pos, n_lines of every line that can be lost."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.split("text", "\n", -1).alias("lines"))
    lines = rows.select("doc_id", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keys = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least)
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "row", "pos", "n_lines")


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of one sorted partition: lost entries, those that the partition before decides, and the last hash."""
    last = None  # (h1, h2, doc_id, row, pos) of the entry before
    home = 0  # the document in which the present hash came first, as far as this partition knows
    inside = False  # whether a hash began in this partition
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, pos = (batch[c].to_numpy(zero_copy_only=False) for c in ORDER)
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begins[0] = last is None or (h1[0], h2[0]) != last[:2]
        run = np.cumsum(begins)
        first = np.concatenate(([home], doc[begins]))[run]
        repeat = np.zeros(len(h1), bool)
        repeat[1:] = ~begins[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (pos[1:] == pos[:-1])
        repeat[0] = last == (h1[0], h2[0], doc[0], row[0], pos[0])
        # Of the partition's first hash, the document that comes first here may not be the first of all.
        undecided = (run == (1 if last is None else 0)) & (not inside) & (doc == first) & ~repeat
        for kind, some in ((LOST, (doc > first) & ~repeat), (OPEN, undecided)):
            at = np.flatnonzero(some)
            if len(at):
                yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), *(batch[c].take(pa.array(at)) for c in [*ORDER, "n_lines"])], [*("kind", *ORDER), "n_lines"])
        inside = inside or bool(run[-1] > (1 if last is None else 0))
        home = int(first[-1])
        last = (h1[-1], h2[-1], doc[-1], row[-1], pos[-1])
    if last is not None:
        values = [LAST, int(last[0]), int(last[1]), home, 0, 0, 0]
        types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], [*("kind", *ORDER), "n_lines"])


def to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, lost in zip(batch["n_lines"].to_pylist(), batch["lost"], strict=True):
            keep = np.ones(n, bool)
            keep[lost.values.to_numpy(zero_copy_only=False)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch["doc_id"], batch["row"], batch["n_lines"], batch["n_dropped"], pa.array(maps, pa.binary())], ["doc_id", "row", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, row, n_lines, n_dropped, keep of every row that loses lines."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written first: the range partitioning samples its input, and the texts are read once.
    entries = written(line_entries(documents, least), "lines")
    ordered = entries.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    reports = written(ordered.mapInArrow(first_seen, REPORT), "line-reports")
    lasts = reports.where(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("doc_id").alias("home"))
    late = reports.where(F.col("kind") == OPEN).join(lasts, ["h1", "h2"]).where("home < doc_id")
    columns = ["doc_id", "row", "pos", "n_lines"]
    lost = reports.where(F.col("kind") == LOST).select(columns).union(late.select(columns))
    by_row = lost.groupBy("doc_id", "row", "n_lines").agg(F.collect_set("pos").alias("lost"))
    return by_row.withColumn("n_dropped", F.size("lost")).mapInArrow(to_bitmaps, "doc_id long, row long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> bytes:
    """The lines of a text whose bits are set; all without a bitmap."""
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def dedup_lines(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """document (struct of all input columns), n_lines, n_dropped, kept of each row."""
    bitmaps = keep_bitmaps(documents, least).select("doc_id", "row", "n_dropped", "keep")
    rows = documents.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id").cast("long"), F.col("text")).alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch["text"].cast(pa.large_binary()).to_pylist()]
            keep = batch["keep"].to_pylist()
            kept = [kept_lines(t, k) for t, k in zip(texts, keep, strict=True)]
            n_lines = pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())
            n_dropped = batch["n_dropped"].cast(pa.int64()).fill_null(0)
            yield pa.record_batch([batch["document"], n_lines, n_dropped, pa.array(kept, pa.binary()).cast(pa.string())], ["document", "n_lines", "n_dropped", "kept"])

    schema = StructType([rows.schema["document"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    return rows.join(bitmaps, ["doc_id", "row"], "left").select("document", "text", "keep", "n_dropped").mapInArrow(cut, schema)
