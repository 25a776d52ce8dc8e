from __future__ import annotations

import random

from tallyspark.llm.licences import TEMPLATES, scan_licences
from tests.llm.brute import frame


def test_every_template_is_found_anywhere(spark):
    filler = [f"word{k}" for k in range(40)]
    rows, expected = [], set()
    for i, (name, kind, text) in enumerate(TEMPLATES):
        for shift in range(8):
            doc_id = 10 * i + shift
            rows.append((doc_id, " ".join(filler[: 5 + shift]) + f"\n** {text.upper()} **\n" + " ".join(filler[5:])))
            expected.add((doc_id, name, kind))
    got = {(r["doc_id"], r["license"], r["template"]) for r in scan_licences(frame(spark, rows)).collect()}
    assert expected <= got
    # What else is found holds that template's words as well.
    assert all(k in ("notice", "notice-2") for _, _, k in got - expected)


def test_partial_clean_null_and_native(spark):
    mit = next(t for a, b, t in TEMPLATES if (a, b) == ("MIT", "permission")).split()
    rows = [(1, " ".join(mit[:-4])), (2, " ".join(mit[: len(mit) // 2])), (3, None), (4, ""), (5, "the license"), (6, "x " * 50_000 + "released under the mit license"), (6, "Released under the MIT license"), (None, "Released under the MIT License")]
    found = scan_licences(frame(spark, rows))
    got = sorted(((r["doc_id"], r["template"]) for r in found.collect()), key=str)
    assert got == sorted([(1, "permission"), (6, "notice"), (6, "notice"), (None, "notice")], key=str)
    plan = scan_licences(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "RDD"))
    assert scan_licences(frame(spark, [])).count() == 0


def test_matches_at_the_threshold_in_scattered_words(spark):
    def text(seed):
        r = random.Random(seed)
        filler = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(10, 16)))
        return " ".join(f"{filler()} {p}" for p in ("licensed under cc", "under cc by", "cc by nc", "nc 4 0")) + " " + filler()

    seeds = [481, 1499, 1766, 2060, 3081, 3425, 4537, 5226, 5529, 5683, 5804, 7211]  # of 8,000, what windows at every sixth word miss
    template = [t for t in TEMPLATES if t[:2] == ("CC-BY-NC-4.0", "notice")]
    got = {r["doc_id"]: r["n_matched"] for r in scan_licences(frame(spark, [(i, text(i)) for i in seeds]), template).collect()}
    assert got == dict.fromkeys(seeds, 4)
