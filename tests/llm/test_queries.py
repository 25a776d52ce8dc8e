"""Registered queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from tallyspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.brute import jaccard, substrings

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert set(ORACLE_SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(connect(SF), ORACLE_SQL[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    ids = [[r["doc_id"] for r in s.collect()] for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids[1])
    judged = [(d in kept) == bool(q) for d, q in labels.items() if q is not None]
    assert sum(judged) / len(judged) > 0.95
    texts = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    groups = jaccard(texts, 5, 80)
    assert sorted(ids[2]) == sorted(d for d, (_, c) in groups.items() if c == d)
    texts = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    cut = {d: (n, gone) for d, n, gone, _ in substrings(texts, 13)}
    assert sorted(ids[3]) == sorted(d for d, (n, gone) in cut.items() if not gone or gone < n)
    after = {r["doc_id"]: r for r in steps[3].collect()}
    assert all(len(after[d]["text"].split()) == n - gone for d, (n, gone) in cut.items() if d in after and gone)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"]: r["text"].lower().split() for r in steps[3].collect()}
    leaked = {d for d, w in held.items() for t in items if any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1))}
    assert leaked.isdisjoint(ids[4]) and set(ids[4]) <= set(ids[3])
    assert len(set(ids[3]) - set(ids[4])) < 0.1 * len(ids[3])
    assert set(ids[5]) == set(ids[4])
    final = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_tokens").collect()))
    assert final == sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in steps[5].collect())
