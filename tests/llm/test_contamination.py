from __future__ import annotations

import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.contamination import align, find_leaks, rarest, seeds_of
from tallyspark.llm.hashing import hash_words
from tests.llm.brute import frame, smith_waterman


def test_align_is_smith_waterman():
    r = random.Random(4)
    for _ in range(200):
        a = [r.randrange(6) for _ in range(r.randrange(1, 15))]
        b = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        top, first, last = align(np.array(a), np.array(b))
        assert top == smith_waterman(a, b)
        if top:
            assert smith_waterman(a, b[first : last + 1]) == top


def leaks(spark, rows, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(frame(spark, rows), bench, **more).select("document.doc_id", F.explode("hits").alias("h"))
    return {(x["doc_id"], x["h"]["item_id"]): (x["h"]["score"], x["h"]["first_word"], x["h"]["last_word"]) for x in found.collect()}


def test_exact_edited_and_clean(spark):
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "a", "in", *(f"v{k}" for k in range(400))]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, say(30)) for i in range(20)]
    edited = {i: [w if k % 5 else "changed" for k, w in enumerate(t)] for i, t in items}
    dropped = {i: [w for k, w in enumerate(t) if k % 6 != 3] for i, t in items}
    rows, expected = [], set()
    for i, t in items:
        for k, passage in enumerate((t, edited[i], dropped[i])):
            doc_id = 100 * k + i
            rows.append((doc_id, " ".join(say(50) + [w.upper() + "," if k else w for w in passage] + say(40))))
            expected.add((doc_id, i))
    rows += [(1000 + i, " ".join(say(200))) for i in range(40)]
    rows.append((1500, " ".join(say(60) + items[6][1][4:18] + say(60))))  # an excerpt
    rows.append((1501, " ".join(say(60) + items[6][1][4:13] + say(60))))  # too short a one
    expected.add((1500, 6))
    rows += [(2000, None), (2001, ""), (2002, "the of and"), (None, " ".join(items[3][1])), (2003, ("x " + " ".join(items[4][1]) + " y ") * 300)]
    expected |= {(None, 3), (2003, 4)}
    bench = [(i, " ".join(t)) for i, t in items] + [(77, None), (78, ""), (None, "never said so anywhere else")]
    got = leaks(spark, rows, bench)
    assert set(got) == expected
    assert got[(3, 3)] == (1.0, 50, 79)
    # The same in several passes over the documents.
    assert leaks(spark, rows, bench, chunk_words=150) == got


def test_short_items_repeats_and_empty_tables(spark):
    assert set(leaks(spark, [(1, "say Hello, world now"), (2, "hello there")], [(1, "hello world"), (1, "hello world"), (2, "none")])) == {(1, 1)}
    assert leaks(spark, [], [(1, "a b c d")]) == {} and leaks(spark, [(1, "a b c d")], []) == {}
    row = find_leaks(frame(spark, [(1, "a")]), spark.createDataFrame([], "item_id long, text string")).first()
    assert row["document"]["hits"] == 2 and row["hits"] == []


def test_lone_edited_copies_and_excerpts_equal_all_pairs(spark):
    r = random.Random(8)
    vocabulary = ["the", "of", "and", "a", "in", *(f"v{k}" for k in range(400))]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, say(30 if i < 5 else 60)) for i in range(10)]
    rows = []
    for i, t in items[:5]:  # the only copy in the corpus
        rows.append((i, " ".join(say(50) + [w if k % 5 != 2 else "changed" for k, w in enumerate(t)] + say(40))))
    for i, t in items[5:]:  # excerpts, and exact copies elsewhere for some
        start = r.randrange(47)
        rows.append((i, " ".join(say(50) + t[start : start + 13] + say(40))))
        if i > 6:
            rows.append((100 + i, " ".join(say(20) + t + say(20))))
    rows += [(1000 + i, " ".join(say(100))) for i in range(10)]
    expected = {}
    for doc_id, text in rows:
        for i, t in items:
            top = smith_waterman(t, text.split())
            if top >= len(t) or top >= 26:
                expected[(doc_id, i)] = top / (2 * len(t))
    got = leaks(spark, rows, [(i, " ".join(t)) for i, t in items])
    assert {k: v[0] for k, v in got.items()} == expected
    assert {(i, i) for i, _ in items} <= set(got)


def test_capitals_and_composed_forms_of_any_script(spark):
    item = "Élève àgé où ça Öl Übung ñandú señal ΟΔΟΣ όπως Слово Straße été noël"
    forms = [item.upper(), item.lower(), unicodedata.normalize("NFD", item), unicodedata.normalize("NFD", item.upper()), item.title()]
    got = leaks(spark, [(i, f"before it {t} after it") for i, t in enumerate(forms)], [(1, item)])
    assert got == {(i, 1): (1.0, 2, 15) for i in range(len(forms))}


def test_columns_of_any_name_come_back(spark):
    df = frame(spark, [(1, "a b")]).withColumnRenamed("key", "crawl-id").withColumnRenamed("told", "my col")
    row = find_leaks(df, spark.createDataFrame([(1, "x y z")], "item_id long, text string")).first()
    assert row["document"]["crawl-id"] == "k" and row["document"]["my col"] == 1 and row["hits"] == []


def test_rarest_of_every_run():
    r = random.Random(9)
    for _ in range(100):
        counts, run = [r.randrange(1, 5) for _ in range(r.randrange(1, 30))], r.randrange(1, 14)
        runs = [range(a, a + min(run, len(counts))) for a in range(max(1, len(counts) - run + 1))]
        expected = [any(i in x and counts[i] == min(counts[j] for j in x) for x in runs) for i in range(len(counts))]
        assert rarest(np.array(counts), run).tolist() == expected


def test_phrases_of_many_items_are_no_seeds_but_where_nothing_is_rarer(spark):
    r = random.Random(10)
    asked = "which of the following statements best describes the main point of this passage and why would its author say so".split()
    # Shorter than a run: never a seed. As long as one: a copy of it alone is an excerpt of every item.
    items = [(i, asked[:8] + [f"u{r.randrange(500)}" for _ in range(22)]) for i in range(40)] + [(i, asked + [f"u{r.randrange(500)}" for _ in range(22)]) for i in range(40, 60)]
    words = [hash_words([" ".join(t).encode()]).hashes for _, t in items]
    seeds = seeds_of([i for i, _ in items], words)
    assert max(np.diff(seeds.first)) <= 20 < 60
    rows = [(i, " ".join(["x"] * 30 + [w if k % 4 else "changed" for k, w in enumerate(t)] + ["y"] * 30)) for i, t in items[::4]]
    rows += [(100 + i, " ".join(["x"] * 9 + items[i][1][-14:] + ["y"] * 9)) for i in range(0, 60, 7)]
    rows += [(200, " ".join(["x", *asked, "y"])), (201, " ".join(["x", *asked[:12], "y"]))]
    expected = {}
    for doc_id, text in rows:
        for i, t in items:
            top = smith_waterman(t, text.split())
            if top >= len(t) or top >= 26:
                expected[(doc_id, i)] = top / (2 * len(t))
    got = leaks(spark, rows, [(i, " ".join(t)) for i, t in items])
    assert {k: v[0] for k, v in got.items()} == expected
    assert {i for d, i in expected if d == 200} == set(range(40, 60)) and not any(d == 201 for d, _ in expected)
