"""Approximate nearest neighbours by multi-index hashing.

Codes: the signs of several learned rotations (iterative quantisation: principal
axes, then a rotation that turns towards the signs it yields, from several
random starts) of the vectors, 256 bits for 64 dimensions. Rows are dealt into
blocks, queries into chunks, and each (block, chunk) is one task's work: the
stated query set against all rows, in blocks.

In a block every byte of the codes has an index: for each of its 256 values,
the bitmap of the rows within so many bits of that value. Of two codes within
``m (a + 1) - 1`` bits, at least one of the m bytes is within ``a`` bits
(pigeonhole), so the union of the bitmaps that a query's bytes probe holds
every code within that radius. The radius grows until the ``near``-th code by
Hamming distance lies inside it; all codes as near as that one are reranked by
their inner product in double precision. Rows with equal vectors have equal
codes and are retrieved together. A block smaller than ``near`` is ranked
whole, so every query gets ``k`` rows if there are as many candidates.

Nulls and edge cases: vectors that are null, empty, zero, of another length
than most of the sample, or hold null or non-finite components take no part,
nor do rows without vec_id. A query's own row and repeats of its vec_id are no
candidates; a query id that is repeated is searched once, by its first vector
in order of the vector's hash; other repeated rows count one by one. Ties go to
the smaller vec_id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROTATIONS = 4
SAMPLE = 20_000  #: vectors that the rotations are learned from, at most
BLOCK, CHUNK = 8192, 2048
NEAR = 512  #: codes of a block that are reranked, at least (and all that tie)


def learn_rotations(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d x bits) of the sign codes."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :64]
    flat = centred @ axes
    parts = []
    random = np.random.default_rng(11)
    for _ in range(rotations):
        turn = np.linalg.qr(random.standard_normal((flat.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return mean, np.concatenate(parts, axis=1)


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Sign codes as bytes, padded to whole 64-bit words."""
    code = np.packbits((vectors - mean) @ projection > 0, axis=1)
    return np.pad(code, ((0, 0), (0, -code.shape[1] % 8)))


def search_block(ids, vectors, codes, query_ids, queries, query_codes, k: int, near: int = NEAR):
    """For each query its k best rows of the block: query, row, score arrays."""
    rows, m = codes.shape
    if not rows or not len(query_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # index[j][v]: rows whose byte j is within a bits of v; a starts at 0 and grows.
    index = np.zeros((m, 256, (rows + 7) // 8), np.uint8)
    for j in range(m):
        is_value = np.zeros((256, rows), bool)
        is_value[codes[:, j], np.arange(rows)] = True
        index[j] = np.packbits(is_value, axis=1)
    words, query_words = np.ascontiguousarray(codes).view(np.uint64), np.ascontiguousarray(query_codes).view(np.uint64)
    want = min(near + 1, rows)  # one more, as the query itself may be among them
    out = []
    pending = np.arange(len(query_ids))
    values = np.arange(256)
    for a in range(9):
        left = []
        for part in np.array_split(pending, max(1, len(pending) // 64)):
            if not len(part):
                continue
            probed = index[0][query_codes[part, 0]]
            for j in range(1, m):
                probed |= index[j][query_codes[part, j]]
            distance = np.zeros((len(part), rows), np.uint16)
            for w in range(words.shape[1]):
                distance += np.bitwise_count(query_words[part, w, None] ^ words[None, :, w])
            distance[np.unpackbits(probed, axis=1, count=rows) == 0] = 9999
            edge = np.partition(distance, want - 1, axis=1)[:, want - 1]
            whole = edge <= m * (a + 1) - 1 if a < 8 else edge >= 0
            left.append(part[~whole])
            for i in np.flatnonzero(whole):
                found = np.flatnonzero(distance[i] <= edge[i])
                found = found[ids[found] != query_ids[part[i]]]
                score = vectors[found] @ queries[part[i]]
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), query_ids[part[i]]), ids[found][best], score[best]))
        pending = np.concatenate(left) if left else pending[:0]
        if not len(pending):
            break
        wider = index.copy()
        for b in range(8):
            wider |= index[:, values ^ (1 << b)]
        index = wider
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, near: int = NEAR) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k rows with the largest inner product.

    ``rows``: vec_id, embedding (array of float or double).
    """
    spark = rows.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(F.coalesce(sound, F.lit(False)))
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    sizes = sample.map(len)
    d = int(sizes.mode().iloc[0])
    mean, projection = learn_rotations(np.array(sample[sizes == d].tolist()))
    kept = kept.where(F.size("embedding") == d)
    shared = spark.sparkContext.broadcast((mean, projection))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            code = codes_of(vectors, *shared.value)
            yield pa.record_batch([batch["vec_id"], pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "vector", "code"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [b"".join(pdf["vector"])], "codes": [b"".join(pdf["code"])]})

    def packed(df: DataFrame, size: int, place: Column) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // size))
        coded = df.mapInArrow(encode, "vec_id long, vector binary, code binary")
        return coded.groupBy(F.pmod(F.xxhash64(place), F.lit(parts)).cast("int").alias("part")).applyInPandas(pack, "part int, ids binary, vectors binary, codes binary"), parts

    queries = kept.where(is_query).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    # Rows are dealt by their place in the scan, so repeats spread over the blocks too. Queries come out of a
    # shuffle, whose order may differ when a task runs again; there are no repeats, and their key deals them evenly.
    blocks, n_blocks = packed(kept, BLOCK, F.monotonically_increasing_id())
    chunks, _ = packed(queries, CHUNK, F.col("vec_id"))
    tiles = blocks.join(chunks.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.col("codes").alias("query_codes")), "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                ids, query_ids = (np.frombuffer(tile[c], np.int64) for c in ("ids", "query_ids"))
                vectors, asked = (np.frombuffer(tile[c]).reshape(-1, d) for c in ("vectors", "queries"))
                codes, query_codes = (np.frombuffer(tile[c], np.uint8).reshape(len(n), -1) for c, n in (("codes", ids), ("query_codes", query_ids)))
                found = search_block(ids, vectors, codes, query_ids, asked, query_codes, k, near)
                yield pa.record_batch([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
