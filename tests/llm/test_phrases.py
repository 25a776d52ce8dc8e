from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import phrases
from tallyspark.llm.phrases import compact, mine_phrases, path_texts, phrase_graph
from tests.llm.brute import DOCS, lower


def brute(rows, least, share=50, top=2000):
    """Rows of the result from plain counts; rows: (lang, text)."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            inside = [b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * b >= share * a for b in inside):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    columns = [(i, text, lang, "s", None, "k", 1, 2, 3, 0.5, "d") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(columns, DOCS.replace("key string", "word string").replace("told int", "u int").replace("hits int", "f int"))


def corpus(seed=5, rows=160):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefghij") * 2 + str(r.randrange(4)) for _ in range(r.randrange(3, 30))) for _ in range(6)]
    out = []
    for i in range(rows):
        words = [r.choice(["the", "Of", "and", "a", "é", "Ünd", "x1", "x2"]) for _ in range(r.randrange(60))]
        text = r.choice(["", " ", "\t"]).join(w + r.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b", "! "]) for w in words)
        out.append((r.choice(["en", "en", "de", None, "und"]), text + r.choice(["", " " + r.choice(passages)])))
    return [*out, ("en", None), (None, ""), ("en", ".,;:!?"), ("fr", "one"), ("en", "the of " * 500), ("de", "ha " * 400), *[("es", passages[0])] * 12]


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("least", [10, 3])
def test_against_brute_force(spark, least):
    rows = corpus()
    assert result(mine_phrases(frame(spark, rows), least)) == brute(rows, least)


def test_top_and_ties(spark):
    rows = [("en", ". ".join(f"{a}{i} {a}{i}z" for a in "edcba" for i in range(5)))] * 4
    got = result(mine_phrases(frame(spark, rows), 4, top=7))
    assert got == brute(rows, 4, top=7) and len(got) == 7 and [g[2] for g in got][:2] == ["a0 a0z", "a1 a1z"]


def test_many_slices_hot_nodes_and_runs(spark, monkeypatch):
    # Everything hot, slices of few records, runs of few words, waiting records summed at once.
    rows = corpus(9)
    whole = result(mine_phrases(frame(spark, rows), 5))
    monkeypatch.setattr(phrases, "SLICE_RECORDS", 50)
    monkeypatch.setattr(phrases, "SAMPLE_LEAST", 1)
    hot, n_slices, _ = phrases.hot_nodes(frame(spark, rows), len(rows), 4)
    assert n_slices > 40 and len(hot) > 20
    assert result(mine_phrases(frame(spark, rows), 5)) == whole == brute(rows, 5)


def test_long_texts_are_summed_in_runs(monkeypatch):
    texts = [("a b c d. e f " * 40).encode(), b"", b"b c " * 30]
    u, v, w, *_ = phrases.records(texts)
    monkeypatch.setattr(phrases, "_BITS", 5)
    seen = Counter()
    for batch in phrases.pack_part("en", texts, 3, np.zeros(0, np.uint64)):
        for e in batch.to_pylist():
            hashes, n = np.frombuffer(e["hashes"], np.uint64), phrases.widened(e["counts"])
            ids = np.frombuffer(e["ids"], np.uint16).reshape(3, -1)
            for a, b, c, k in zip(*hashes[ids].tolist(), n.tolist(), strict=True):
                seen[a, b, c] += k
    assert seen == Counter(zip(u.tolist(), v.tolist(), w.tolist(), strict=True))


def test_lexsort_gives_what_keys_give(monkeypatch):
    r = np.random.default_rng(2)
    hashes = np.sort(r.integers(0, 1 << 60, 30).astype(np.uint64))
    u, v, w, n = (r.integers(0, 30, 500) for _ in range(4))
    keyed = phrases.summed(hashes, u, v, w, n)
    monkeypatch.setattr(phrases, "_BITS", 2)
    assert all((a == b).all() for a, b in zip(keyed, phrases.summed(hashes, u, v, w, n), strict=True))


def test_flow_of_the_graph(spark):
    rows = corpus(3)
    graph = phrase_graph(frame(spark, rows), 4)
    plain = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = piece.split()
            for k in (1, 2, 3):
                plain[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["word"]): r["f"] for r in graph.words.collect()} == {(x, g): c for x, counts in plain.items() for g, c in counts.items() if " " not in g and c >= 4}
    assert graph.nodes.count() == sum(c >= 4 and g.count(" ") == 1 for counts in plain.values() for g, c in counts.items())
    paths = {(r["lang"], r["phrase"]): r["n"] for r in path_texts(graph).collect()}
    assert paths and all(plain[x][" ".join(p.split()[i : i + 3])] == n for (x, p), n in paths.items() for i in range(len(p.split()) - 2))
    # Whole passages become one path, as far as their words are their own.
    assert max(len(p.split()) for _, p in paths) >= 6


def test_long_path_is_contracted_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, what: (rounds.append(what), real(df, what))[1])
    edges = spark.createDataFrame([("en", i, i + 1, i + 2, 7, 7, 7) for i in range(1, 2001)], "lang string, u long, v long, w long, n long, f_out long, f_in long")
    path = compact(edges).collect()
    assert len(path) == 1 and path[0]["words"] == list(range(1, 2003)) and path[0]["n"] == 7
    assert rounds.count("path-state") <= 14


def test_large_counts_are_exact(spark):
    a = 3_000_000_000_000
    graph = phrases.Graph(
        spark.createDataFrame([("en", 9 * a)], "lang string, n long"),
        spark.createDataFrame([("en", 1, "x", 3 * a), ("en", 2, "y", 2 * a + 1)], "lang string, u long, word string, f long"),
        spark.createDataFrame([("en", 1, 2, 2 * a)], "lang string, u long, v long, f long"),
        spark.createDataFrame([], "lang string, u long, v long, w long, n long, f_out long, f_in long"),
        spark.createDataFrame([], "lang string, words array<long>, n long"),
    )
    got = result(phrases.rank_phrases(graph, 50, 10))
    assert got == [("en", 1, "x y", 2 * a, 3 * a, 2 * a + 1, 9 * a, 1_000_000 * (2 * a) ** 2 // (3 * a * (2 * a + 1)))]


def test_empty_table(spark):
    assert mine_phrases(frame(spark, [("en", "a b")]).limit(0)).count() == 0
    assert mine_phrases(frame(spark, [("en", None), (None, "a b")])).count() == 0
