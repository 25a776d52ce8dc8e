"""Hard negatives by exact scores from subset-sum tables (Four Russians).

Components become integers ``floor(256 x)``; a score is an integer inner product.

* Candidates are packed in blocks as bit planes: plane b holds, for every eight
  dimensions, one byte of a row with bit b of these eight components (two's
  complement, as many planes as the block's largest component needs).
* Of an anchor, each group of eight dimensions has a table of the 256 subset
  sums of its components. A plane's byte selects the sum of the components whose
  bit is set; sums over the groups, shifted by b and added over the planes (the
  top plane counts negative), are the full exact scores of the block.

Every anchor meets every block: blocks and chunks of anchors are tables of their
own, and their product is one row for each (block, chunk), never copied for a shuffle. A first pass finds the anchor's nearest
rows of the same label, a second one the best rows of other labels within each
positive's band. Each block reports a few rows for each anchor, and windows
over these reports keep the best. No pair outlives its block.

Nulls and edge cases: rows with a null label, a null vec_id, a null vector or a
null or non-finite component take no part, nor do vectors with a component
beyond +-2^18 (their scores might leave 64 bits). Vectors only meet others of
their length; empty ones score 0. An anchor id that is repeated counts once, as
its row with the smallest (label, vector); rows that repeat an anchor's vec_id
are not candidates of it, other repeated rows count one by one. Equal scores go
to the smaller vec_id. An anchor without positives, or a positive without
negatives in its band, gives no rows, nor does an empty table. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import written

SCALE = 256
LARGEST = float(1 << 18)  #: components beyond it take no part: 2^26 squared, by up to 2^11 dimensions, fits 64 bits
BLOCK, CHUNK = 16_384, 1_024
BLOCKS = "d int, part int, bits int, ids binary, labels binary, planes binary"
CHUNKS = "d int, ids binary, labels binary, vectors binary, highs binary, lows binary, places binary"


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Planes x groups of eight dimensions x rows, as bytes; the last plane is the sign's."""
    rows, d = vectors.shape
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    bits = max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1
    padded = np.zeros((rows, -(-d // 8) * 8), np.int64)
    padded[:, :d] = vectors
    out = np.empty((bits, padded.shape[1] // 8, rows), np.uint8)
    for b in range(bits):
        out[b] = np.packbits(((padded >> b) & 1).astype(bool), axis=1, bitorder="little").T
    return out


def subset_sums(vector: np.ndarray) -> np.ndarray:
    """Groups of eight dimensions x 256: the sum of the components whose bits are set."""
    padded = np.zeros(-(-len(vector) // 8) * 8, np.int64)
    padded[: len(vector)] = vector
    groups = padded.reshape(-1, 8)
    table = np.zeros((len(groups), 256), np.int64)
    for k in range(8):
        table[:, 1 << k : 2 << k] = table[:, : 1 << k] + groups[:, k, None]
    return table.astype(np.int32) if np.abs(padded).sum() < 1 << 31 else table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of one anchor's tables with all rows of a block."""
    bits, groups, rows = planes.shape
    total = np.zeros(rows, np.int64)
    for b in range(bits):
        plane = np.zeros(rows, table.dtype)
        for g in range(groups):
            plane += table[g].take(planes[b, g])
        shifted = plane.astype(np.int64) << b
        if b == bits - 1:
            total -= shifted
        else:
            total += shifted
    return total


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def scaled_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label, d, values of every row that takes part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= F.lit(LARGEST)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(sound, F.lit(False)))
    return kept.select("vec_id", "label", F.size("embedding").alias("d"), F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("values"))


def matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.array(values.tolist(), np.int64).reshape(len(values), d)


def pack_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    planes = bit_planes(matrix(pdf["values"], int(key[0])))
    ids, labels = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
    return pd.DataFrame({"d": [key[0]], "part": [key[1]], "bits": [len(planes)], "ids": [ids], "labels": [labels], "planes": [planes.tobytes()]})


def pack_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk of anchors; highs, lows, places: the bands of each anchor, padded to the same number with empty ones."""
    ids, labels = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
    bands = [[] if b is None else list(b) for b in pdf["bands"]]
    most = max(map(len, bands))
    highs, lows, places = np.full((len(bands), most), -1), np.zeros((len(bands), most), np.int64), np.zeros((len(bands), most), np.int64)
    for i, some in enumerate(bands):
        for j, band in enumerate(some):
            highs[i, j], lows[i, j], places[i, j] = band["high"], band["low"], band["place"]
    return pd.DataFrame({"d": [key[0]], "ids": [ids], "labels": [labels], "vectors": [matrix(pdf["values"], int(key[0])).tobytes()], "highs": [highs.tobytes()], "lows": [lows.tobytes()], "places": [places.tobytes()]})


def tiles(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each (block, chunk of anchors) of one length; anchors: vec_id, label, d, values, bands.

    A product of two written tables. Were the chunks repeated for every block and joined by key,
    Spark would take them for as small as one of each and broadcast all the repeats.
    """
    chunks = max(1, -(-anchors.count() // CHUNK))
    dealt = anchors.groupBy("d", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")).applyInPandas(pack_chunk, CHUNKS)
    dealt = dealt.select(F.col("d").alias("anchor_d"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), "vectors", "highs", "lows", "places")
    # Not as an equality of columns: that would deal all blocks of one length to one task.
    return blocks.crossJoin(written(dealt, "chunks")).where("d - anchor_d = 0").drop("anchor_d")


def unpacked(tile: dict) -> Iterator[tuple]:
    """Of each anchor of a tile: its number, id and label, and the block's ids, labels and scores."""
    ids, labels, anchor_ids, anchor_labels = (np.frombuffer(tile[c], np.int64) for c in ("ids", "labels", "anchor_ids", "anchor_labels"))
    planes = np.frombuffer(tile["planes"], np.uint8).reshape(tile["bits"], -(-tile["d"] // 8), len(ids))
    vectors = np.frombuffer(tile["vectors"], np.int64).reshape(len(anchor_ids), tile["d"])
    for i, (anchor, label) in enumerate(zip(anchor_ids, anchor_labels, strict=True)):
        yield i, anchor, label, ids, labels, scores(subset_sums(vectors[i]), planes)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def reported(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(len(names))]
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names)


def nearest_of_label(blocks: DataFrame, anchors: DataFrame, positives: int) -> DataFrame:
    """anchor_id, place (from 1), positive_id, positive_score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in rows_of(batches):
            found = []
            for _, anchor, label, ids, labels, score in unpacked(tile):
                same = np.flatnonzero((labels == label) & (ids != anchor))
                at = same[best(ids[same], score[same], positives)]
                found.append((np.full(len(at), anchor), ids[at], score[at]))
            yield reported(found, ["anchor_id", "positive_id", "positive_score"])

    found = tiles(blocks, anchors.withColumn("bands", F.array().cast("array<struct<place:long,high:long,low:long>>")))
    found = found.mapInArrow(search, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)


def best_of_bands(blocks: DataFrame, anchors: DataFrame, negatives: int) -> DataFrame:
    """anchor_id, place, rank, negative_id, negative_score; anchors with their bands."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in rows_of(batches):
            found = []
            shape = (len(tile["anchor_ids"]) // 8, -1)
            highs, lows, places = (np.frombuffer(tile[c], np.int64).reshape(shape) for c in ("highs", "lows", "places"))
            for i, anchor, label, ids, labels, score in unpacked(tile):
                other = np.flatnonzero((labels != label) & (ids != anchor) & (score <= highs[i].max()) & (score >= lows[i].min()))
                for high, low, place in zip(highs[i], lows[i], places[i], strict=True):
                    if low <= high:
                        some = other[(score[other] <= high) & (score[other] >= low)]
                        at = some[best(ids[some], score[some], negatives)]
                        found.append((np.full(len(at), anchor), np.full(len(at), place), ids[at], score[at]))
            yield reported(found, ["anchor_id", "place", "negative_id", "negative_score"])

    found = tiles(blocks, anchors).mapInArrow(search, "anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)


def mine_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. A negative has between ``low`` and
    ``high`` percent of its positive's score.
    """
    # Written with a random deal: rows are spread evenly over the blocks, repeats too, and stay there.
    kept = written(scaled_rows(rows).withColumn("deal", F.monotonically_increasing_id()), "vectors")
    n_blocks = max(1, -(-kept.count() // BLOCK))
    part = F.pmod(F.xxhash64("deal"), F.lit(n_blocks)).cast("int").alias("part")
    # By number: a file holds a block or a few, and the products are spread over the files.
    dealt = kept.withColumn("part", part).repartition(n_blocks, "d", "part")
    blocks = written(dealt.groupBy("d", "part").applyInPandas(pack_block, BLOCKS), "blocks")
    anchors = kept.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "d", "values")).alias("r")).select("vec_id", "r.*")
    anchors = written(anchors, "anchors")
    near = written(nearest_of_label(blocks, anchors, positives), "positives")
    # Whole numbers: 100 n <= high p and low p <= 100 n. A negative positive score leaves no room.
    share = lambda percent: F.col("positive_score").cast("decimal(38,0)") * percent / 100
    band = F.struct(F.col("place").cast("long").alias("place"), F.floor(share(high)).cast("long").alias("high"), F.ceil(share(low)).cast("long").alias("low"))
    bands = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(band).alias("bands"))
    found = best_of_bands(blocks, anchors.join(bands, "vec_id"), negatives)
    joined = found.join(near.withColumn("place", F.col("place").cast("long")), ["anchor_id", "place"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
