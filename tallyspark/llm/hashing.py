"""Vectorised hashes of words and word windows.

A polynomial hash modulo 2^64 of every word comes from one prefix sum over the
bytes of many texts (an odd base has an inverse, so a prefix can be cut off),
that of every window from a second prefix sum over the mixed word hashes.
Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACES = _SPACE.tobytes()
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Odd bases of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WINDOW_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Texts are hashed in groups of so many bytes, whose sums a core's cache holds, or one longer text.
GROUP_BYTES = 1 << 17
TABLE = 1 << 18  #: powers that are kept
#: Batches are worked on in parts of so many bytes, or one longer text.
PART_BYTES = 1 << 22

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, from 0 to at least n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(TABLE + 2, n + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = (out[0], out[1])
        if n <= TABLE + 1:
            _powers[base] = have  # tables for longer texts are not kept
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Hashed words of several texts, in a row."""

    hashes: np.ndarray  #: uint64, of each word
    begin: np.ndarray  #: of each text, its first word
    end: np.ndarray  #: of each text, the word after its last

    def text_of(self) -> np.ndarray:
        """Of each word, its text."""
        return np.repeat(np.arange(len(self.begin)), self.end - self.begin)


def hash_words(texts: list[bytes], base: int = BASES[0]) -> Words:
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = np.frombuffer(joined.translate(SPACES), np.bool_)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    # A word's first byte, the byte after its last, by turns: the last byte of all is white space.
    first = edge[::2]
    up, down = powers(base, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    body = total[1:]
    np.add(data, np.uint64(1), out=body, dtype=np.uint64)
    body *= up[: len(data)]
    np.cumsum(body, out=body)
    at = total[edge]
    hashes = mix((at[1::2] - at[::2]) * down[first])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    words = np.searchsorted(first, np.concatenate(([0], np.cumsum(lengths))))
    return Words(hashes, words[:-1], words[1:])


def hash_windows(hashes: np.ndarray, n: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """Of each position, the hash of n words from there; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def binaries(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part's ``text`` has at most so many bytes, or is one row.

    What is made of a part is gone before the next one: memory follows the part, not the batch.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size + 1) // most
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def groups(texts: list[bytes | None], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
