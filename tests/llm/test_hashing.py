"""Hashes of words."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np

from tallyspark.llm.hashing import BASES, GROUP_BYTES, hash_words, mix


def test_hashes_by_their_definition():
    """Every word's polynomial hash, wherever it stands; empty and blank texts have no words."""
    texts = [b"", b"a", b" a", b"b ", b"\x0b \t", b"ab  c\r\n\xc3\xa9t\xc3\xa9", b"", b"\xa0x\x1f"]
    for some in ([], [b""], [b" "], [b"x"], texts, texts[::-1]):
        found = hash_words(some)
        words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in some]
        values = [sum((c + 1) * pow(BASES[0], i, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for ws in words for w in ws]
        assert found.hashes.tolist() == mix(np.array(values, np.uint64)).tolist()
        assert (found.end - found.begin).tolist() == [len(ws) for ws in words]


def test_a_group_is_hashed_in_two_megabytes():
    """What a group of texts takes beside its words stays in a core's cache."""
    text = (b"w" * 39 + b" ") * (GROUP_BYTES // 40)
    hash_words([text])  # the tables of powers are kept
    tracemalloc.start()
    hash_words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 21
