from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import jaccard as jaccard_module, shared
from tallyspark.llm.jaccard import by_slice, ids_of, jaccard_components, links, may_link, packed, prefix, second_order, shingle_sets, signature, slice_of
from tallyspark.llm.shared import may_hold, member_bits, written
from tests.llm.brute import frame, jaccard


def result(df, words, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, words, percent).collect()}


def near(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def test_against_brute_force(spark):
    r = random.Random(3)
    line = "a very common line that stands in many of the documents here"
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 90))) + (f" {line}" if i % 2 else "")) for i in range(120)]
    base = [f"b{k}" for k in range(200)]
    # A list longer than SMALL whose members are only partly linked: centres, then blocks.
    rows += [(1000 + i, near(r, base, r.randrange(0, 16))) for i in range(90)]
    for i in range(40):
        rows.append((2000 + i, near(r, rows[i][1].split(), r.randrange(0, 4))))
    rows += [(3000, line), (3001, line.upper()), (3002, "One two"), (3003, "one  TWO"), (3004, None), (3005, " \n"), (3006, ""), (3007, "É one two three four"), (3008, "é one two three four")]
    rows += [(3100 + i, "x " * 5000) for i in range(30)]
    expected = jaccard(rows, 4, 85)
    assert result(frame(spark, rows), 4, 85) == expected
    assert len({c for _, c in expected.values()}) > 100
    # Dealt over many tasks: sets of a list meet within a task, in the token's slice, or both.
    assert result(frame(spark, [*rows, *rows[::7]]).repartition(9), 5, 80) == jaccard(rows, 5, 80)


def test_rows_without_id_and_empty_table(spark):
    rows = [(1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (1, "a b c d e")]
    got = sorted((tuple(r) for r in jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)], key=str)
    assert jaccard_components(frame(spark, [])).count() == 0


def test_packing_by_slice():
    r = np.random.default_rng(5)
    tokens = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    ids = ids_of(tokens, 7)
    assert (ids >> np.uint64(32) == slice_of(tokens, 7)).all() and len(np.unique(ids >> np.uint64(32))) == 7
    rows = list(packed(ids >> np.uint64(32), [ids, tokens]))
    back = {p: list(zip(*(c.tolist() for c in columns), strict=True)) for p, columns in by_slice(rows + rows, [np.uint64, np.uint64])}
    assert {p: sorted(x) for p, x in back.items()} == {p: sorted(2 * [(i, t) for i, t in zip(ids.tolist(), tokens.tolist(), strict=True) if i >> 32 == p]) for p in range(7)}
    assert list(packed(ids[:0], [ids[:0]])) == []


def test_filters_keep_every_link():
    r = random.Random(8)
    for _ in range(200):
        base = [f"b{k}" for k in range(r.randrange(4, 120))]
        a, b = (next(shingle_sets([near(r, base, r.randrange(0, 3)).encode()], 4)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            for q, one, two in ((prefix, a, b), (lambda n, _: -(-n // 10), second_order(a), second_order(b))):
                assert may_link(len(a), signature(one, 2 * q(len(a), 85)), len(b), signature(two, 2 * q(len(b), 85)), 85)
            assert links(a, b, 85)
        else:
            assert not links(a, b, 85)
    assert len(second_order(a)) == len(a)


def test_texts_and_windows_stay_where_they_are_read(spark, monkeypatch):
    """However many ids are wanted: rows with a long text or window never meet an exchange before they are picked."""
    bits = member_bits(spark.range(5000).select(F.xxhash64("id").alias("h")), "h")
    hashes = np.array([r["h"] for r in spark.range(40_000).orderBy("id").select(F.xxhash64("id").alias("h")).collect()], np.int64)
    found = may_hold(bits.value, hashes)
    assert found[:5000].all() and found[5000:].mean() < 0.05
    r = random.Random(6)
    rows = [(i, near(r, [f"w{i % 40}x{k}" for k in range(60)], i % 4)) for i in range(160)]
    plans = []

    def keep(df, what):
        plans.append((what, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, what)

    monkeypatch.setattr(jaccard_module, "written", keep)
    # As if the bitmap were far too small for its ids, all else passes; the result is the same.
    monkeypatch.setattr(shared, "MOST_BITS", 1 << 15)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result(frame(spark, rows), 4, 85) == jaccard(rows, 4, 85)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [plan for what, plan in plans if what in ("signatures", "sets")]
    assert len(wide) >= 2 and not any("Join" in plan for plan in wide)


def test_table_of_frequent_tokens_holds_those_of_some_gigabytes():
    # check_s, 0.10 GB, has 17,750 frequent tokens. A table of 262,144 was full beyond 1.5 GB: common tokens counted as rare then.
    assert jaccard_module.RANKED >= 17_750 * 60
    assert 1 << jaccard_module.LAST_BITS[1] >= 8 * jaccard_module.RANKED
