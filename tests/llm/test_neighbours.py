from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.neighbours import nearest
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    got = found(QUERIES["op9_nearest_embeddings"](spark, SF))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    truth = brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert got.keys() == truth.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.9


def test_recall_over_many_blocks(spark):
    random = np.random.default_rng(3)
    vectors = random.standard_normal((12_000, 24))
    vectors[:3000] = vectors[0]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") % 1000 == 7, 20))
    hits = 0
    for q, best in got.items():
        order = np.lexsort((np.arange(len(vectors)), -(vectors @ vectors[q])))
        want = [int(i) for i in order if i != q][:20]
        hits += len(set(want) & {i for i, _ in best})
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for i, s in best)
    assert len(got) == 12 and hits / (20 * len(got)) >= 0.9


def test_unsound_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (2, [0.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = found(nearest(df, F.lit(True), 20))
    assert got == {0: [(1, 1.0), (2, 0.0), (2, 0.0)], 1: [(0, 1.0), (2, 0.0), (2, 0.0)], 2: [(0, 0.0), (1, 0.0)]}
    assert found(nearest(df, F.col("vec_id") == 0, 1)) == {0: [(1, 1.0)]}
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_queries_are_dealt_by_key(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = nearest(rows, F.col("vec_id") % 4 == 0, k=3)._jdf.queryExecution().analyzed().toString()
    # The place in the scan deals the rows, and nothing that comes out of a shuffle.
    assert plan.count("monotonically_increasing_id()") == 1
