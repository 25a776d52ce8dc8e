"""Substring deduplication with difference-cover anchors.

A word goes if a window of L words covers it whose word sequence also starts in
a document with a smaller doc_id. Windows are judged on the input.

1. Anchors. Of every document only the sub-windows are hashed that start at the
   positions of a difference cover D modulo v (v = 7, D = {0, 1, 3} for L = 13),
   each L - v + 1 words long. For any two places i, j there is a k < v with
   i + k and j + k both in the cover, so two equal windows share an anchor.
2. Anchors meet by hash; those of several documents are reported back.
3. Extension. Windows around a shared anchor are hashed whole (96 bits) and meet
   by hash; those that a smaller doc_id holds too are reported as late.

Hashes meet packed: each part of a batch first settles what it can see itself (a
hash in several of its documents needs no reply) and sends one entry per hash
and batch, so a passage in a third of all documents reaches a partition once
per batch, not once per document. No pairs are made.

Nulls and edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.
Texts of fewer than L words lose nothing. Rows without doc_id neither lose
words nor take any from others. Rows that repeat a doc_id do not touch each
other. An empty table gives no rows. All columns of the input come back in the
struct ``document``, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.hashing import WINDOW_BASES, binaries, groups, hash_windows, hash_words, slices
from tallyspark.llm.shared import written

# Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ENTRY = "part int, h binary, c binary, i binary, rows binary, docs binary, seen binary"
NAMES = ["part", "h", "c", "i", "rows", "docs", "seen"]


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for windows of so many words."""
    period = max(v for v in COVERS if 2 * v <= window + 1)
    return period, COVERS[period], window - period + 1


def batch_words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, and the word hashes, rows and places in the row of a group of texts."""
    texts = [t or b"" for t in binaries(batch["text"])]
    for start, end in groups(texts):
        words = hash_words(texts[start:end])
        row = words.text_of()
        yield start, end, words.hashes, row, np.arange(len(row)) - words.begin[row]


def starts(row: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from here lie in one row."""
    out = np.zeros(len(row), bool)
    if len(row) >= n:
        out[: len(row) - n + 1] = row[: len(row) - n + 1] == row[n - 1 :]
    return out


def anchors_of(hashes: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a group's anchors and their hashes."""
    period, cover, length = cover_for(window)
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    at = np.flatnonzero(starts(row, length) & in_cover[place % period])
    return at, hash_windows(hashes, length)[at] if len(at) else np.zeros(0, np.uint64)


def pack(h, c, row, keys, docs, parts: int, late: bool) -> Iterator[pa.RecordBatch]:
    """A batch's part of a meeting: replies it can give itself, and one entry per hash for the others.

    h, c: hash and check of each window; row: its row in the batch. keys, docs: of the rows.
    Replies have part = -1. Of an anchor's hash 40 bits are sent, besides those that choose the
    partition: a rare false meeting only makes windows candidates.
    """
    order = np.lexsort((c, h)) if late else np.argsort(h, kind="stable")
    h, c, row = h[order], c[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) if late else h[1:] != h[:-1]
    # One entry for a hash that a row holds at several places (rows ascend within a hash).
    keep = new.copy()
    keep[1:] |= row[1:] != row[:-1]
    h, c, row, new = h[keep], c[keep], row[keep], new[keep]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    doc = docs[row]
    least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    seen = (least != most)[group]
    told = (doc > least[group]) if late else seen
    if told.any():
        yield from told_to(h[told], keys[row[told]])
    send = (doc == least[group]) if late else (~seen | new)
    h, c, row, seen = h[send], c[send], row[send], seen[send] & (not late)
    part = (h % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    h, c, row, seen, part = h[order], c[order], row[order], seen[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    out = {n: [] for n in NAMES}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        used, index = np.unique(row[a:b], return_inverse=True)
        out["part"].append(int(part[a]))
        out["h"].append(h[a:b].tobytes() if late else (h[a:b] >> np.uint64(32)).astype(np.uint32).tobytes() + (h[a:b] >> np.uint64(24)).astype(np.uint8).tobytes())
        out["c"].append(c[a:b].tobytes() if late else b"")
        out["i"].append(index.astype(np.uint32 if len(used) > 65536 else np.uint16).tobytes())
        out["rows"].append(keys[used].tobytes())
        out["docs"].append(docs[used].tobytes() if late else b"")
        out["seen"].append(b"" if late else np.packbits(seen[a:b]).tobytes())
    yield pa.record_batch([pa.array(out["part"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in NAMES[1:])], NAMES)


def told_to(h: np.ndarray, keys: np.ndarray, parts: int = 0) -> Iterator[pa.RecordBatch]:
    """Replies (the hashes told to the rows with these keys), packed: one row, or one per partition of the keys.

    rows: distinct keys; i: how many hashes each is told; h: the hashes in this order.
    """
    target = keys.view(np.uint64) % np.uint64(parts) if parts else np.zeros(len(keys), np.uint64)
    order = np.lexsort((keys, target))
    h, keys, target = h[order], keys[order], target[order]
    edges = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, count = np.unique(keys[a:b], return_counts=True)
        row = [h[a:b].tobytes(), b"", count.astype(np.uint32).tobytes(), own.tobytes(), b"", b""]
        part = int(target[a]) if parts else -1
        yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], NAMES)


def unpacked(entry: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hash and key of each packed reply."""
    keys = np.frombuffer(entry["rows"], np.int64)
    return np.frombuffer(entry["h"], np.uint64), np.repeat(keys, np.frombuffer(entry["i"], np.uint32))


def meet(batches: Iterator[pa.RecordBatch], parts: int, late: bool) -> Iterator[pa.RecordBatch]:
    """One partition of a meeting: replies to the rows whose hash others hold too, by partition of the rows."""
    held: list[tuple] = []
    given: list[tuple[np.ndarray, np.ndarray]] = []
    all_keys: list[np.ndarray] = []
    base = 0
    for batch in batches:
        for e in batch.to_pylist():
            if e["part"] < 0:
                given.append(unpacked(e))
                continue
            rows = np.frombuffer(e["rows"], np.int64)
            if late:
                h, c = np.frombuffer(e["h"], np.uint64), np.frombuffer(e["c"], np.uint32)
            else:
                n = len(e["h"]) // 5
                h = (np.frombuffer(e["h"], np.uint32, n).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(e["h"], np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(24))
                c = np.zeros(0, np.uint32)
            index = np.frombuffer(e["i"], np.uint16 if len(e["i"]) == 2 * len(h) else np.uint32).astype(np.int32) + base
            docs = np.frombuffer(e["docs"], np.int64)[index - base] if late else np.zeros(0, np.int64)
            seen = np.zeros(0, bool) if late else np.unpackbits(np.frombuffer(e["seen"], np.uint8), count=len(h)).astype(bool)
            held.append((h, c, index, docs, seen))
            all_keys.append(rows)
            base += len(rows)
    if held:
        h, c, index, docs, seen = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        keys = np.concatenate(all_keys)
        order = np.lexsort((c, h)) if late else np.argsort(h, kind="stable")
        h, index = h[order], index[order]
        new = np.ones(len(h), bool)
        if late:
            c, docs = c[order], docs[order]
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            found = docs > np.minimum.reduceat(docs, first)[np.cumsum(new) - 1]
        else:
            seen = seen[order]
            new[1:] = h[1:] != h[:-1]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            own = keys[index]
            shared = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | np.logical_or.reduceat(seen, first)
            found = shared[group] & ~seen
        given.append((h[found], keys[index[found]]))
    if given:
        h, keys = (np.concatenate(x) for x in zip(*given, strict=True))
        if len(h):
            yield from told_to(h, keys, parts)


def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key: all hashes it is told."""
    given = [unpacked(e) for batch in batches for e in batch.to_pylist()]
    if not given:
        return
    h, keys = (np.concatenate(x) for x in zip(*given, strict=True))
    order = np.argsort(keys, kind="stable")
    h, keys = h[order], keys[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    for some in np.array_split(np.arange(len(edges) - 1), -(-(len(edges) - 1) // 10_000)):
        told = [h[edges[k] : edges[k + 1]].tobytes() for k in some]
        yield pa.record_batch([pa.array(keys[edges[some]]), pa.array(told, pa.binary())], ["key", "told"])


def with_text(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches, and of each document its text, the column at this place; nothing is copied."""
    for batch in batches:
        document = batch["document"]
        yield pa.record_batch([document, pc.struct_field(document, [place]), batch["told"]], ["document", "text", "told"])


def meeting(entries: DataFrame, late: bool) -> DataFrame:
    """(key, told) of every row that gets replies; entries as packed by ``pack``."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each hash range is one partition; replies that a batch gave itself are spread by their rows.
    where = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int"))
    met = entries.repartitionById(parts, where).mapInArrow(lambda b: meet(b, parts, late), ENTRY)
    return met.repartitionById(parts, F.col("part")).mapInArrow(regroup, "key long, told binary")


def dedup_substrings(documents: DataFrame, window: int = 13) -> DataFrame:
    """document (struct of all input columns), n_words, n_removed, kept of each document."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = documents.columns
    text_at = names.index("text") if "text" in names else [n.lower() for n in names].index("text")
    # The key of a row: equal for rows that are equal in id and text, which fare alike.
    rows = rows.select("document", "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    numbered = rows.where("doc_id IS NOT NULL").select("doc_id", "text", "key")

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, owner = [], []
            for start, _, hashes, row, place in batch_words(batch):
                at, h = anchors_of(hashes, row, place, window)
                found.append(h)
                owner.append(row[at] + start)
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            if len(h):
                keys, docs = (batch[n].to_numpy(zero_copy_only=False) for n in ("key", "doc_id"))
                yield from pack(h, np.zeros(len(h), np.uint32), np.concatenate(owner).astype(np.int32), keys, docs, parts, False)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period = cover_for(window)[0]
        for batch in slices(batches):
            told = batch["told"].to_pylist()
            found, checks, owner = [], [], []
            for start, end, hashes, row, place in batch_words(batch):
                at, h = anchors_of(hashes, row, place, window)
                shared = np.zeros(len(row) + 1, np.int32)
                cut = h >> np.uint64(24)
                edges = np.searchsorted(row[at], np.arange(end - start + 1))
                for r in range(end - start):
                    a, b = edges[r], edges[r + 1]
                    if a < b:
                        mine = np.frombuffer(told[start + r], np.uint64) >> np.uint64(24)
                        shared[at[a:b][np.isin(cut[a:b], mine)]] = 1
                # A window is a candidate if one of its first ``period`` places has a shared anchor.
                ahead = np.concatenate(([0], np.cumsum(shared)))
                far = np.minimum(np.arange(len(row)) + period, len(row))
                first = np.flatnonzero((ahead[far] > ahead[: len(row)]) & starts(row, window))
                found.append(hash_windows(hashes, window)[first] if len(first) else np.zeros(0, np.uint64))
                checks.append((hash_windows(hashes, window, WINDOW_BASES[1])[first] >> np.uint64(32)).astype(np.uint32) if len(first) else np.zeros(0, np.uint32))
                owner.append(row[first] + start)
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            if len(h):
                keys, docs = (batch[n].to_numpy(zero_copy_only=False) for n in ("key", "doc_id"))
                yield from pack(h, np.concatenate(checks), np.concatenate(owner).astype(np.int32), keys, docs, parts, True)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(with_text(batches, text_at)):
            texts = binaries(batch["text"])
            told = batch["told"].to_pylist()
            counts, removed, kept = [], [], []
            for text, late in zip(texts, told, strict=True):
                words = WORD.findall(text or b"")
                gone = 0
                if late and len(words) >= window:
                    h = hash_windows(hash_words([text]).hashes, window)
                    bad = np.isin(h, np.frombuffer(late, np.uint64)).astype(np.int32)
                    covered = np.zeros(len(words) + 1, np.int32)
                    covered[: len(bad)] += bad
                    covered[window : window + len(bad)] -= bad
                    stays = np.cumsum(covered[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    counts.append(len(words))
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                else:
                    counts.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.record_batch([batch["document"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["document", "n_words", "n_removed", "kept"])

    shared = written(meeting(numbered.mapInArrow(find_anchors, ENTRY), False), "anchors")
    candidates = numbered.join(shared, "key").mapInArrow(extend, ENTRY)
    late = written(meeting(candidates, True), "late")
    schema = T.StructType([rows.schema["document"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    # A text crosses this join inside its document alone.
    return rows.select("document", "key").join(late, "key", "left").select("document", "told").mapInArrow(remove, schema)
