"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, told int, hits int, n int, score double, document string"


def frame(spark, rows, schema: str = DOCS):
    """Documents with columns whose names the operators use themselves; rows: (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "k", 1, 2, 3, 0.5, "d") for r in rows], schema)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def jaccard(rows, words: int, percent: int) -> dict:
    """Component of each doc_id."""
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                moved = True
    return {d: (len(sets[d]), comp[d]) for d in sets}


def substrings(rows, window: int) -> list:
    """(doc_id, n_words, n_removed, sha256 of what is kept) of each row."""
    first: dict = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                s = tuple(w[i : i + window])
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def smith_waterman(a: list, b: list) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def best_fit(items, capacity: int) -> list[int]:
    """Tightest compatible bin, the oldest of equal ones; items: (size, source, cluster)."""
    bins: list[list] = []
    out = []
    for size, source, cluster in items:
        fits = [i for i, (left, s, c) in enumerate(bins) if left >= size and left > 0 and (source < 0 or source not in s) and cluster not in c]
        if fits and size < capacity:
            i = min(fits, key=lambda i: (bins[i][0], i))
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        out.append(i)
    return out
