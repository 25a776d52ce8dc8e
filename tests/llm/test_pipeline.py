"""Stages of the pipeline on odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpus_pipeline import cut_repeats, drop_leaks, keep_good, keep_one_of_group, pack

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, set_key long, `crawl-id` string, `my col` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 7, "c", 1) for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


ONE = " ".join(f"one{k}" for k in range(80))
NEAR = ONE.replace("one7 ", "changed ")
TWO = " ".join(f"two{k}" for k in range(40))


def test_rows_of_one_id_with_other_texts_stay(spark):
    """No text without a copy goes, whatever ids it shares."""
    rows = [(1, ONE), (1, TWO), (2, TWO), (3, NEAR), (4, None), (4, ""), (None, ONE), (None, None), (5, "few words"), (6, "few words"), (6, "own words here")]
    want = [(1, ONE), (1, TWO), (5, "few words"), (6, "own words here"), (None, ONE), (None, None)]
    got = kept(keep_one_of_group(spark, docs(spark, rows), SF))
    assert [r for r in got if r[0] != 4] == sorted(want, key=str) and len([r for r in got if r[0] == 4]) == 1
    # Two near copies under one id: one of them, the same whatever the order of rows.
    both = [(1, ONE), (1, NEAR), (1, ONE)]
    one, two = (kept(keep_one_of_group(spark, docs(spark, r).repartition(n), SF)) for r, n in ((both, 1), (both[::-1], 3)))
    assert one == two and len(one) == 1


@pytest.mark.parametrize("stage", [keep_good, keep_one_of_group, cut_repeats, drop_leaks])
def test_columns_nulls_and_empty_tables(spark, stage):
    given = docs(spark, [(1, ONE), (2, None), (None, TWO), (3, "")])
    found = stage(spark, given, SF)
    assert found.columns == given.columns
    assert all(r["crawl-id"] == "c" and r["my col"] == 1 and r["score"] == 0.5 and r["set_key"] == 7 for r in found.collect())
    assert stage(spark, given.limit(0), SF).count() == 0


def test_packing_of_odd_rows(spark):
    given = docs(spark, [(1, ONE), (1, ONE), (2, None), (None, TWO)])
    assert [r["n_tokens"] for r in pack(spark, given, SF).orderBy("n_tokens").collect()] == [0, 40, 80, 80]
    assert pack(spark, given.limit(0), SF).count() == 0


def test_stages_are_five_in_order():
    assert [s for _, s in corpus_pipeline.STAGES] == [keep_good, keep_one_of_group, cut_repeats, drop_leaks, pack]
