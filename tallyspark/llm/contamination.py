"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and all bytes beyond ASCII, of the text
with cases folded and in composed form (NFC). Seeds are the rare word trigrams
of the test items: in every run of ``run_words`` words of an item, those that
occur least in the items (of its chunk, see below). Edits and excerpts leave no
saying which ones a copy still holds, so all that tie are seeds: trigrams that
occur once always are, and every exact run of ``run_words`` words holds one. A
phrase that many items share is only a seed where there is nothing rarer around
it. Where a seed occurs in a document, the passage around it that the whole item could cover is aligned with
the item (match 2, mismatch and gap -1); passages of one item that overlap are
one. The score is that of the best local alignment over that of an exact copy.
A hit scores at least ``threshold``, or its alignment is worth at least
``run_words`` matching words, as an excerpt of a long item may be. Passages that
share too few words with the item for either, in any order, are not aligned:
where a seed is a common trigram of documents, its passages end there.
Documents are matched where they are read; nothing of them is shuffled.

The test items are taken in chunks of a bounded number of words, which are
broadcast; a larger benchmark takes more passes over the documents.

Nulls and edge cases: null texts have no words. Items of fewer than three words
are seeded whole, items without words match nothing. Repeated items are matched
each. An item's best passage of a document is reported, the first among equal
ones. Empty tables give no rows. All columns of the documents come back in the
struct ``document``, so their names cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.hashing import LOWER, binaries, groups, hash_windows, hash_words, slices

GRAM = 3
CHUNK_WORDS = 1_000_000  #: of test items per pass
THRESHOLD = 0.5
RUN_WORDS = 13
MATCH, OTHER = 2, -1
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
HITS = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"
HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


@dataclass
class Seeds:
    """Test items of a chunk, and where their n-grams are; slices by n-gram."""

    ids: list[int | None]
    words: list[np.ndarray]
    grams: np.ndarray  #: distinct hashes, ascending
    first: np.ndarray  #: of each hash, its slice of item and place
    item: np.ndarray
    place: np.ndarray
    low: np.ndarray  #: whether a hash ends in these 20 bits: most words are ruled out by it

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold one of the n-grams, and its number."""
        at = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), max(0, len(self.grams) - 1))
        hit = self.grams[gram] == hashes[at] if len(self.grams) else np.zeros(0, bool)
        return at[hit], gram[hit]

    def by_item(self, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each item with one of these n-grams, in order: its number, positions and places."""
        sizes = self.first[gram + 1] - self.first[gram]
        entry = np.repeat(self.first[gram] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        order = np.argsort(self.item[entry], kind="stable")
        at, entry = np.repeat(at, sizes)[order], entry[order]
        item = self.item[entry]
        edges = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(item[a]), at[a:b], self.place[entry[a:b]]


def rarest(counts: np.ndarray, run: int) -> np.ndarray:
    """Places whose count is the least in some run of so many places, or in all if there are fewer."""
    run = min(run, len(counts))
    least = np.lib.stride_tricks.sliding_window_view(counts, run).min(axis=1)
    # Of all runs around a place, the one with the greatest least count decides.
    around = np.pad(least, run - 1)
    return counts <= np.lib.stride_tricks.sliding_window_view(around, run).max(axis=1)


def seeds_of(ids: list, words: list[np.ndarray], run_words: int = RUN_WORDS) -> Seeds:
    """The n-grams that are rarest in some run of ``run_words`` words of an item."""
    h, item, place = [], [], []
    for i, w in enumerate(words):
        n = min(GRAM, len(w))
        if n:
            g = grams_of(w, n)
            h.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
    if h:
        _, gram, count = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        counts = np.split(count[gram], np.cumsum([len(g) for g in h])[:-1])
        rare = [rarest(c, max(1, run_words - GRAM + 1)) for c in counts]
        h, item, place = ([x[r] for x, r in zip(xs, rare, strict=True)] for xs in (h, item, place))
    h, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (item, np.int64), (place, np.int64)))
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    low = np.zeros(1 << 20, bool)
    low[(grams & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return Seeds(ids, words, grams, np.append(first, len(h)), item[order], place[order], low)


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams; those of different n differ."""
    return hash_windows(words, n) ^ np.uint64(n)


def plain(text: bytes | None) -> bytes:
    text = text or b""
    if not text.isascii():
        # Capitals of a sharp s are two letters: folded, not lower-cased. Composed again, as folding may part a mark.
        folded = unicodedata.normalize("NFC", text.decode("utf-8", "replace")).casefold()
        text = unicodedata.normalize("NFC", folded).encode()
    return text.translate(_PLAIN)


def gram_hits(texts: list[bytes | None], seeds: Seeds, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its number, word hashes, hit positions and their n-grams."""
    for start, end in groups(texts):
        hashed = hash_words([plain(t) for t in texts[start:end]])
        row = hashed.text_of()
        found = []
        for n in [*short, GRAM]:
            if len(row) < n:
                continue
            at, gram = seeds.find(grams_of(hashed.hashes, n))
            inside = row[at] == row[at + n - 1]
            found.append((at[inside], gram[inside]))
        if not found:
            continue
        at, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, gram = at[order], gram[order]
        edges = np.searchsorted(at, np.append(hashed.begin, len(row)))
        for r in range(end - start):
            if edges[r] < edges[r + 1]:
                some = slice(edges[r], edges[r + 1])
                yield start + r, hashed.hashes[hashed.begin[r] : hashed.end[r]], at[some] - hashed.begin[r], gram[some]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first and last word of the passage (the first of equal ones)."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        top, end = 0, 0
        for word in a:
            new = np.zeros(len(b) + 1, np.int64)
            new[1:] = np.maximum(row[:-1] + np.where(b == word, MATCH, OTHER), row[1:] + OTHER)
            np.maximum(new, 0, out=new)
            # A gap along the passage costs 1 a word: a running maximum of what is left of earlier cells.
            row = np.maximum(np.maximum.accumulate(new + steps) - steps, 0)
            j = int(row.argmax())
            if row[j] > top or row[j] == top and j < end:
                top, end = int(row[j]), j
        return top, end

    top, end = best(item, passage)
    if not top:
        return 0, 0, 0
    back = best(item[::-1], passage[:end][::-1])[1]
    return top, end - back, end - 1


def passages(at: np.ndarray, places: np.ndarray, length: int, n_words: int) -> list[tuple[int, int]]:
    """Parts of a document that an item could cover, given where its seeds are; overlapping ones as one."""
    margin = length // 2 + 1
    out: list[list[int]] = []
    for a, b in sorted(zip((at - places - margin).tolist(), (at - places + length + margin).tolist(), strict=True)):
        a, b = max(0, a), min(n_words, b)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shared_words(item: np.ndarray, passage: np.ndarray) -> int:
    """No alignment of the two has more matches."""
    return min(int(np.isin(item, passage).sum()), int(np.isin(passage, item).sum()))


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, run_words: int = RUN_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """document (struct of all input columns) and hits of each document (text)."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.xxhash64("item_id", "text"))
    # Words are at most half as many as characters, and one more.
    size = items.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    chunks = max(1, -(-int(size) // chunk_words))
    rows = documents.select(F.struct("*").alias("document"), "text", F.array().cast(HITS).alias("hits"))
    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in ("document", "text", "hits")])
    for c in range(chunks):
        part = items.where(F.pmod("place", F.lit(chunks)) == c).toPandas().sort_values(["item_id", "text"])
        words = [hash_words([plain(t.encode())]).hashes for t in part["text"]]
        ids = [None if v != v or v is None else int(v) for v in part["item_id"]]
        short = sorted({len(w) for w in words if 0 < len(w) < GRAM})
        rows = rows.mapInArrow(_matcher(spark, ids, words, short, threshold, run_words), schema)
    return rows.select("document", "hits")


def _matcher(spark, ids: list, words: list[np.ndarray], short: list[int], threshold: float, run_words: int):
    """Adds one chunk's hits to the documents that are read."""
    every = spark.sparkContext.broadcast((seeds_of(ids, words, run_words), short))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, short = every.value
        for batch in slices(batches):
            hits = batch["hits"].to_pylist()
            for r, hashes, at, gram in gram_hits(binaries(batch["text"]), seeds, short):
                for i, spots, places in seeds.by_item(at, gram):
                    item = seeds.words[i]
                    best = (0, 0, 0)
                    for a, b in passages(spots, places, len(item), len(hashes)):
                        most = shared_words(item, hashes[a:b])
                        if most / len(item) < threshold and most < run_words:
                            continue
                        top, first, last = align(item, hashes[a:b])
                        if top > best[0]:
                            best = (top, a + first, a + last)
                    score = best[0] / (MATCH * len(item))
                    if score >= threshold or best[0] >= MATCH * run_words:
                        hits[r].append({"item_id": seeds.ids[i], "score": score, "first_word": best[1], "last_word": best[2]})
            yield pa.record_batch([batch["document"], batch["text"], pa.array(hits, HIT)], ["document", "text", "hits"])

    return match
