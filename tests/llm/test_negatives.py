from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import negatives
from tallyspark.llm.negatives import bit_planes, mine_negatives, scores, subset_sums

SCHEMA = "vec_id long, label int, embedding array<double>, score string, place int, part int, d int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows, is_anchor, positives=5, wanted=3, low=50, high=95):
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) <= 2**18 for x in v)]
    anchors = {}
    for i, label, v in sound:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in sound if i != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            found = [(i, n) for n, i, same in scored if not same and low * -p <= 100 * -n <= high * -p][:wanted]
            out += [(a, j, rank, i, -p, -n) for rank, (i, n) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("d", [1, 7, 8, 64, 65])
def test_tables_give_inner_products(d):
    r = np.random.default_rng(d)
    for most in (1, 300, 1 << 26):
        rows, anchor = r.integers(-most, most + 1, (50, d)), r.integers(-most, most + 1, d)
        assert (scores(subset_sums(anchor), bit_planes(rows)) == rows @ anchor).all()
    assert len(bit_planes(np.array([[-256, 255]]))) == 9 and len(bit_planes(np.array([[256]]))) == 10


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "CHUNK", 4)
    r = np.random.default_rng(4)
    base = r.standard_normal((300, 12)) / 3
    base[::9] = base[0]  # copies: ties everywhere
    rows = [(i, int(r.integers(3)), v.tolist()) for i, v in enumerate(base)]
    rows += [(20, 1, base[3].tolist()), (21, 2, base[20].tolist()), (41, 0, base[1].tolist())]
    got = result(mine_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0))
    # Repeats of a vec_id count one by one: the same negative may fill several ranks.
    assert got == brute(rows, lambda i: i % 20 == 0) and len({g[0] for g in got}) > 10


def test_unsound_rows_signs_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.9, 0.1]), (3, 2, [0.5, -0.1]), (4, 2, None), (5, None, [1.0, 1.0]), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0]), (8, 1, [None, 1.0])]
    rows += [(9, 2, [2.0**19, 0.0]), (None, 2, [0.9, 0.1]), (10, 1, [1.0, 2.0, 3.0]), (11, 1, []), (12, 2, []), (13, 3, [-1.0, -1.0]), (14, 3, [1.0, -1.5]), (15, 4, [0.0, 0.0]), (16, 4, [0.0, 0.0]), (17, 5, [0.0, 0.0])]
    got = result(mine_negatives(frame(spark, rows), F.lit(True)))
    assert got == brute(rows, lambda i: True) and {0, 15} <= {g[0] for g in got} and 13 not in {g[0] for g in got}
    assert mine_negatives(frame(spark, rows).limit(0), F.lit(True)).count() == 0
    assert mine_negatives(frame(spark, [(0, 1, [1.0])]), F.lit(True)).count() == 0


def test_chunks_are_not_repeated_for_each_block(spark, monkeypatch):
    """What a driver or a shuffle holds of the anchors does not grow with the blocks."""
    monkeypatch.setattr(negatives, "BLOCK", 20)
    monkeypatch.setattr(negatives, "CHUNK", 4)
    made, product = [], negatives.tiles

    def keep(*given):
        made.append(product(*given))
        return made[-1]

    monkeypatch.setattr(negatives, "tiles", keep)
    r = np.random.default_rng(7)
    rows = [(i, int(r.integers(3)), (v / 3).tolist()) for i, v in enumerate(r.standard_normal((200, 8)))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result(mine_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)
        plans = [t._jdf.queryExecution().executedPlan().toString() for t in made]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and all("CartesianProduct" in p and "Generate" not in p for p in plans)
