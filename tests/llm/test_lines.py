from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lines
from tallyspark.llm.lines import dedup_lines, keep_bitmaps, kept_lines
from tests.llm.brute import frame, lower


def brute(rows, least=10):
    """(doc_id, n_lines, n_dropped, sha256) of each row."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first: dict = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                first[key(line)] = min(first.get(key(line), doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        held = (text or "").split("\n")
        kept = [x for x in held if doc_id is None or len(key(x)) < least or first[key(x)] >= doc_id]
        out.append((doc_id, len(held), len(held) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, least=10):
    rows = dedup_lines(df, least).select("document.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    pool = [" ".join(r.choice(["Ab", "cd", "É", "ß1", "x"]) for _ in range(r.randrange(9))) for _ in range(40)] + ["123456789", "1234567890", "éééééééééé", "  Shared line of all  "]
    dress = lambda s: r.choice(["", " ", "\t", "\r", "\x0b\x0c"]) + r.choice([s, s.upper(), s]) + r.choice(["", " ", "\r"])
    rows = [(i, "\n".join(dress(r.choice(pool)) for _ in range(r.randrange(12)))) for i in range(120)]
    rows += [(i, "shared LINE of all\nown line of %d" % i) for i in range(200, 300)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (400, None), (401, ""), (402, "\n\n"), (None, rows[3][1]), (None, None)]
    return [*rows, (500, "again and again\n" * 3000), (501, "again and again\n" * 40), (-5, "shared line of all\nshared line of all")]


@pytest.mark.parametrize("least", [10, 1])
def test_against_brute_force(spark, least):
    rows = corpus()
    assert result(frame(spark, rows), least) == brute(rows, least)


def test_many_repeats_of_one_row(spark):
    rows = [(1, "a line that is long\nsecond long line")] + [(2, "a line that is long\nown to the second")] * 500
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("cut", range(1, 12))
def test_partitions_may_end_anywhere(cut):
    """A stream cut into partitions and batches of any size reports the same, once the open entries are matched."""
    entries = sorted([(h, h, d, d, p, 9) for h, docs in ((1, (4,)), (2, (1, 1, 3, 5, 5)), (3, (2, 7)), (4, (6, 6))) for p, d in enumerate(docs)])
    lost, opened, lasts = set(), [], {}
    for start in range(0, len(entries), cut):
        part = entries[start : start + cut]
        batches = [pa.record_batch([pa.array([e[j] for e in part[i : i + 2]], pa.int64() if j < 4 else pa.int32()) for j in range(6)], [*lines.ORDER, "n_lines"]) for i in range(0, len(part), 2)]
        for batch in lines.first_seen(iter(batches)):
            for x in batch.to_pylist():
                if x["kind"] == lines.LOST:
                    lost.add((x["h1"], x["doc_id"], x["pos"]))
                elif x["kind"] == lines.OPEN:
                    opened.append(x)
                else:
                    lasts[x["h1"]] = min(lasts.get(x["h1"], x["doc_id"]), x["doc_id"])
    lost |= {(x["h1"], x["doc_id"], x["pos"]) for x in opened if lasts.get(x["h1"], x["doc_id"]) < x["doc_id"]}
    assert lost == {(2, 3, 2), (2, 5, 3), (2, 5, 4), (3, 7, 1)}


def test_bitmaps_carry_no_text(spark):
    rows = [(1, "one long line here\nb"), (2, "b\none long line here\nc"), (3, "nothing lost in here")]
    found = keep_bitmaps(frame(spark, rows)).collect()
    assert [(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in found] == [(2, 3, 1)]
    assert np.unpackbits(np.frombuffer(zlib.decompress(found[0]["keep"]), np.uint8))[:3].tolist() == [1, 0, 1]
    assert kept_lines(rows[1][1].encode(), found[0]["keep"]) == b"b\nc" and kept_lines(b"x\ny", None) == b"x\ny"


def test_hot_line_is_dealt_evenly(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same line everywhere").alias("text"))
    entries = lines.line_entries(rows)
    sizes = [r["count"] for r in entries.repartitionByRange(8, *lines.ORDER).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4 * min(sizes)
    assert dedup_lines(rows).where("n_dropped = 1").count() == 19_999


def test_empty_table_and_odd_columns(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a line of some length"), (2, "a line of some length")]).withColumnRenamed("key", "crawl-id").withColumnRenamed("document", "my col").withColumnRenamed("told", "keep")
    row = dedup_lines(df).where("document.doc_id = 2").first()
    assert row["document"]["crawl-id"] == "k" and row["document"]["my col"] == "d" and row["document"]["keep"] == 1 and row["kept"] == ""
