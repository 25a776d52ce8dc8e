"""Conflict-constrained best-fit packing.

Documents become sequences of at most ``capacity`` tokens (words): longer ones
are cut into full pieces and a rest. A bin never holds two pieces of one source
or of one duplicate cluster (equal texts but for case and white space, and near
copies if their groups are given; pieces of one document are one cluster).

Pieces are dealt over shards of bounded size and packed there, largest first.
A shard's open bins are ordered by residual; each carries a bitmap of its
sources and one of its clusters. The search starts at the smallest residual
that holds the piece and goes on to its successors until it finds a compatible
bin, which is the tightest one; ties go to the oldest bin. If there is none, a
new bin is opened. A residual whose bins all hold the source is passed over at
once. Full pieces fill their bins and are not searched for.

Nulls and edge cases: a document without words has one piece of 0 tokens and no
bin. A null source is a source of its own per document, it conflicts with
nothing. Repeated rows are packed each. Null doc_ids are packed like others.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hashing import WINDOW_BASES, binaries, groups, hash_words, mix, powers, slices

CAPACITY = 2048
SHARD = 8192  #: documents of a shard, on average


def pack_shard(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece; pieces come largest first. Sources and clusters are small numbers, -1: no source."""
    residuals: list[int] = []  # of open bins, ascending, each once
    levels: dict[int, list[int]] = {}  # bins of a residual, ascending
    shared: dict[int, int] = {}  # sources that all bins of a residual hold
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []

    def leave(bin_: int, residual: int) -> None:
        level = levels[residual]
        del level[bisect_left(level, bin_)]
        if level:
            common = -1
            for b in level:
                common &= source_bits[b]
                if not common:
                    break
            shared[residual] = common
        else:
            del levels[residual], shared[residual]
            del residuals[bisect_left(residuals, residual)]

    def enter(bin_: int, residual: int) -> None:
        if residual <= 0:
            return
        if residual in levels:
            insort(levels[residual], bin_)
            shared[residual] &= source_bits[bin_]
        else:
            levels[residual] = [bin_]
            shared[residual] = source_bits[bin_]
            insort(residuals, residual)

    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 0 if source < 0 else 1 << source, 1 << cluster
        found = -1
        if size < capacity:
            for i in range(bisect_left(residuals, size), len(residuals)):
                residual = residuals[i]
                if shared[residual] & source_bit:
                    continue
                for b in levels[residual]:
                    if not source_bits[b] & source_bit and not cluster_bits[b] & cluster_bit:
                        found = b
                        break
                if found >= 0:
                    leave(found, residual)
                    source_bits[found] |= source_bit
                    cluster_bits[found] |= cluster_bit
                    enter(found, residual - size)
                    break
        if found < 0:
            found = len(source_bits)
            source_bits.append(source_bit)
            cluster_bits.append(cluster_bit)
            enter(found, capacity - size)
        out.append(found)
    return out


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its number of words and a digest of them that neither case nor white space changes."""
    for batch in slices(batches):
        texts = [b"" if t is None else t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in binaries(batch["text"])]
        n, cluster = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start, end in groups(texts):
            words = hash_words(texts[start:end])
            up, down = powers(WINDOW_BASES[0], len(words.hashes))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * up[: len(words.hashes)], dtype=np.uint64)))
            n.append(words.end - words.begin)
            cluster.append(mix((total[words.end] - total[words.begin]) * down[words.begin] + n[-1].astype(np.uint64)))
        columns = [batch[c] for c in ("doc_id", "source", "place")]
        yield pa.record_batch([*columns, pa.array(np.concatenate(cluster).view(np.int64)), pa.array(np.concatenate(n))], ["doc_id", "source", "place", "cluster", "n"])


def joined(clusters: list[int], groups: list[int]) -> np.ndarray:
    """Clusters of documents that share a cluster or a group, directly or by others; -1: no group."""
    top = list(range(len(clusters)))  # by cluster

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    first: dict[int, int] = {}
    for c, g in zip(clusters, groups, strict=True):
        if g >= 0:
            top[find(c)] = find(first.setdefault(g, c))
    return np.array([find(c) for c in clusters], np.int64)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, groups: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id of each piece (documents: doc_id, source, text).

    ``groups``: component_id of each doc_id; documents of one group conflict.
    """
    items = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        "text",
        F.monotonically_increasing_id().alias("place"),
    ).mapInArrow(measure, "doc_id long, source string, place long, cluster long, n long")
    # Joined after the places are given: those of a scan are the same when a task runs again.
    if groups is None:
        items = items.withColumn("component", F.lit(None).cast("long"))
    else:
        items = items.join(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component")), "doc_id", "left")
    shards = max(1, -(-documents.count() // shard))
    # Dealt by place, so that neither a hot source nor a group of copies fills a shard.
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))

    def pack(shard: int, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-n // capacity))
        own = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[own] - piece * capacity)
        source = pd.factorize(pdf["source"])[0]
        cluster = joined(pd.factorize(pdf["cluster"])[0].tolist(), pd.factorize(pdf["component"])[0].tolist())
        order = np.lexsort((piece, pdf["place"].to_numpy()[own], pdf["doc_id"].fillna(-1).to_numpy()[own], -size))
        order = order[size[order] > 0]
        bins = np.full(len(own), -1, np.int64)
        bins[order] = pack_shard(size[order].tolist(), source[own[order]].tolist(), cluster[own[order]].tolist(), capacity)
        bin_id = pd.Series(np.where(bins < 0, 0, (np.int64(shard) << 32) + bins), dtype="Int64").mask(bins < 0)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy()[own], "piece": piece, "start": piece * capacity, "n_tokens": size, "bin_id": bin_id.to_numpy()})

    def pack_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            for shard_, pdf in pd.concat(held, ignore_index=True).groupby("shard"):
                yield pack(shard_, pdf.reset_index(drop=True))

    # A task for each shard, so that no task gets several.
    return dealt.repartitionById(shards, F.col("shard")).mapInPandas(pack_all, "doc_id long, piece int, start long, n_tokens long, bin_id long")
