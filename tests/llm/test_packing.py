from __future__ import annotations

import random
from collections import defaultdict

from tallyspark.llm.packing import joined, pack_documents, pack_shard
from tallyspark.llm.queries import QUERIES
from tests.llm.brute import best_fit, frame


def test_is_best_fit():
    r = random.Random(1)
    for _ in range(30):
        n = r.randrange(1, 120)
        items = sorted(((r.randrange(1, 65), r.choice([-1, 0, 0, 1, 2, 3]), r.randrange(n)) for _ in range(n)), key=lambda x: -x[0])
        assert pack_shard(*map(list, zip(*items, strict=True)), 64) == best_fit(items, 64)


def test_bins(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 300)) if i % 3 else f"t{i} " * r.randrange(1, 90), r.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(5, rows[5][1], "hot"), (None, "some text", "a"), (900, None, "a"), (901, "", None), (902, "long " * 5000, "c"), (903, "B  c", "x"), (904, "b C ", "y")]
    got = pack_documents(frame(spark, rows), capacity=128, shard=100).collect()
    words = defaultdict(int)
    for d, t, _ in rows:
        words[d] += len((t or "").split())
    held, size, bins = defaultdict(int), defaultdict(int), defaultdict(list)
    for g in got:
        held[g["doc_id"]] += g["n_tokens"]
        assert 0 <= g["n_tokens"] <= 128 and g["start"] == 128 * g["piece"]
        assert (g["bin_id"] is None) == (g["n_tokens"] == 0)
        if g["bin_id"] is not None:
            size[g["bin_id"]] += g["n_tokens"]
            bins[g["bin_id"]].append(g["doc_id"])
    assert held == words and max(size.values()) <= 128
    source = {d: s for d, _, s in rows}
    text = {d: " ".join((t or "").lower().split()) for d, t, _ in rows}
    for docs in bins.values():
        sources = [source[d] for d in docs if source[d] is not None]
        assert len(sources) == len(set(sources))
        assert len({text[d] for d in docs}) == len(docs)
    assert pack_documents(frame(spark, [])).count() == 0


def test_near_copies_conflict(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    near = {i: " ".join(base[: 60 - i]) for i in range(4)}
    rows = [(i, t, None) for i, t in near.items()] + [(10 + i, f"other text {i}", None) for i in range(4)]
    frame(spark, [*rows, rows[0], (None, near[0], None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).select("doc_id", "bin_id").collect()]
    copies = [b for d, b in got if d is None or d < 4]
    assert len(got) == 10 and len(copies) == len(set(copies)) == 6
    assert {b for d, b in got if d is not None and d >= 10} <= set(copies)
    assert joined([0, 1, 2, 2, 3], [-1, 5, 5, 6, 6]).tolist()[1:] == [joined([0, 1, 2, 2, 3], [-1, 5, 5, 6, 6])[1]] * 4
