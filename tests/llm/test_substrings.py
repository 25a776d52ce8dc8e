from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.substrings import COVERS, cover_for, dedup_substrings
from tests.llm.brute import frame, substrings


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_equal_windows_share_an_anchor():
    for window in (3, 5, 13, 30, 50):
        period, cover, length = cover_for(window)
        assert length >= 1
        for i in range(period):
            for j in range(period):
                shared = [k for k in range(period) if (i + k) % period in cover and (j + k) % period in cover]
                assert shared and shared[0] + length <= window


def result(df, window):
    rows = dedup_substrings(df, window).select("document.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("window", [13, 5])
def test_against_brute_force(spark, window):
    r = random.Random(window)
    pool = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [r.choice(pool).split() for _ in range(r.randrange(4))]
        cut = [w for p in parts for w in p[r.randrange(30) :][: r.randrange(1, 60)]]
        rows.append((i, " \t".join(cut + [f"own{i}x{k}" for k in range(r.randrange(20))])))
    rows += [(7, rows[7][1]), (7, rows[9][1]), (500, None), (501, ""), (502, "  \n "), (None, rows[3][1]), (None, None)]
    rows += [(600, "same " * 3000), (601, "same " * 40), (602, pool[0] * 40)]
    assert result(frame(spark, rows), window) == sorted(substrings(rows, window), key=str)


def test_empty_table_and_columns_come_back(spark):
    df = frame(spark, [])
    assert dedup_substrings(df).count() == 0
    row = dedup_substrings(frame(spark, [(1, "a b")])).first()
    assert row["document"]["key"] == "k" and row["document"]["told"] == 1 and row["kept"] == "a b"


def test_columns_of_any_name_come_back(spark):
    df = frame(spark, [(1, "a b")]).withColumnRenamed("key", "crawl-id").withColumnRenamed("told", "my col")
    row = dedup_substrings(df).first()
    assert row["document"]["crawl-id"] == "k" and row["document"]["my col"] == 1


def test_a_text_crosses_the_last_join_once(spark):
    """The join with the late windows carries each document and no second copy of its text; a text by another case is found too."""
    rows = [(1, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"w{i}" for i in range(9, 50))), (3, None), (None, "x y")]
    df = frame(spark, rows).withColumnRenamed("text", "Text").select("source", "Text", "doc_id", "key")
    found = dedup_substrings(df)
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert [c.split("#")[0] for c in plan.left().output().mkString(" ").split()] == ["document", "key"]
    assert result(df, 13) == sorted(substrings(rows, 13), key=str)
    assert {r["document"]["Text"] for r in found.collect()} == {t for _, t in rows}
