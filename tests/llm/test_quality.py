from __future__ import annotations

import numpy as np

from tallyspark.llm.quality import SLOTS, descend, fit_quality, score_quality, slots_of
from tallyspark.llm.queries import QUERIES
from tests.llm.brute import frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op10_quality_score"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored.collect())


def test_slots_are_of_the_whole_text():
    long = b"word " * 400_000 + b"|| end"
    one, two = slots_of([long, b"|| end"])
    assert set(two) - set(one) == set() or len(set(two) - set(one)) <= 4  # n-grams across the seam only
    assert [len(s) for s in slots_of([b"", b"a", b" "])][0] == 0


def test_descent_separates():
    rows = [np.array([i % 2, 2 + i % 5]) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w, bias = descend(rows, np.ones(SLOTS), y, 1.0, 50)
    assert all(np.sign(w[r].sum() + bias) == s for r, s in zip(rows, y, strict=True))


def test_nulls_empty_and_one_class(spark):
    rows = [(1, None), (2, ""), (3, "some text here"), (3, "some text here"), (None, "x"), (5, "y " * 90_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(3, 1), (5, 0), (9, 1), (None, 0), (1, None)], "doc_id long, label int")
    found = score_quality(docs, fit_quality(docs, labels))
    assert {(r["document"]["score"], r["document"]["key"]) for r in found.collect()} == {(0.5, "k")}
    scored = found.select("document.doc_id", "score").collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    assert len({r["score"] for r in scored if r["doc_id"] == 3}) == 1
    none = fit_quality(docs, labels.where("false"))
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    ones = fit_quality(docs, labels.where("label = 1"))
    assert min(r["score"] for r in score_quality(docs, ones).collect()) > 0.9
    assert score_quality(docs.limit(0), none).count() == 0


def test_one_row_of_an_id_is_learned_from(spark):
    """However often an id is repeated, the driver gets one row; which one does not depend on the order of rows."""
    rows = [(1, f"good text number {i % 7}") for i in range(3000)] + [(2, "bad || text ((")] * 3000
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, label int")
    models = [fit_quality(frame(spark, some).repartition(n), labels) for some, n in ((rows, 3), (rows[::-1], 8))]
    assert all((a == b).all() for a, b in ((models[0].weights, models[1].weights), (models[0].squares, models[1].squares)))


def brute_model(texts, labels, cost, rounds):
    """NB-SVM in plain Python: ratios from counts, then the dual objective that descent should reach."""
    import math

    sets = [s.tolist() for s in slots_of(texts)]
    good, bad = [s for s, y in zip(sets, labels, strict=True) if y], [s for s, y in zip(sets, labels, strict=True) if not y]
    ratio = {k: math.log((1 + sum(k in s for s in good)) / (1 + len(good))) - math.log((1 + sum(k in s for s in bad)) / (1 + len(bad))) for k in {k for s in sets for k in s}}
    rows = []
    for s in sets:
        length = math.sqrt(sum(ratio[k] ** 2 for k in s) + 1)
        rows.append({k: ratio[k] / length for k in s} | {"bias": 1 / length})
    return ratio, rows


def test_descent_reaches_the_dual_optimum():
    texts = [b"a good text, one", b"another good text", b"bad (( text", b"|| bad bad", b"good and bad"]
    labels = [1, 1, 0, 0, 1]
    ratio, rows = brute_model(texts, labels, 1.0, 400)
    y = np.array([1.0 if v else -1.0 for v in labels])
    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    gram = np.array([[y[i] * y[j] * dot(rows[i], rows[j]) for j in range(len(rows))] for i in range(len(rows))])
    alpha = np.zeros(len(rows))
    for _ in range(20_000):  # projected gradient on the dual
        alpha = np.clip(alpha - 0.05 * (gram @ alpha - 1), 0, 1.0)
    values = np.zeros(SLOTS)
    for k, v in ratio.items():
        values[k] = v
    slots = [np.array(sorted(k for k in r if k != "bias"), np.int64) for r in rows]
    w, bias = descend(slots, values, y, 1.0, 2000)
    want = {k: sum(alpha[i] * y[i] * rows[i].get(k, 0.0) for i in range(len(rows))) for k in [*ratio, "bias"]}
    assert abs(bias - want.pop("bias")) < 1e-2 and all(abs(w[k] - v) < 1e-2 for k, v in want.items())
