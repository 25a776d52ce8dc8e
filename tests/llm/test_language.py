from __future__ import annotations

import numpy as np

from tallyspark.llm import language
from tallyspark.llm.queries import QUERIES
from tests.llm.brute import frame

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    random = np.random.default_rng(1)
    net = language.Network(["a", "b"], random.standard_normal((2, 256, 9)) * 0.5, random.standard_normal((2, 3, 9)) * 0.5, random.standard_normal((6, 2)), random.standard_normal(2))
    windows, truth = random.integers(60, 70, (4, 7)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = language.gradients(net, windows, truth)
    for p, g in zip(net.parameters(), grads, strict=True):
        spots = np.argsort(-np.abs(g).ravel())[:6]
        for k in spots:
            at = np.unravel_index(k, p.shape)
            old = p[at]
            p[at] = old + 1e-4
            up, _ = language.gradients(net, windows, truth)
            p[at] = old - 1e-4
            down, _ = language.gradients(net, windows, truth)
            p[at] = old
            assert abs((up - down) / 2e-4 - g[at]) < 1e-3 * max(1.0, abs(g[at]))


def test_pooling_is_over_all_positions_of_a_text():
    random = np.random.default_rng(2)
    net = language.train([b"aaaa bbbb " * 9, b"xxxx yyyy " * 9], ["p", "q"], rounds=20)
    texts = [b"aa", b"x" * 64, bytes(random.integers(97, 122, 200).astype(np.uint8)), b"b" * 65]
    for text, row in zip(texts, language.pooled(net, texts), strict=True):
        alone = np.zeros(2)
        for start in range(0, len(text), language.STEPS):
            part = text[start : start + language.STEPS]
            window = np.frombuffer(part + b" " * (language.STEPS - len(part)), np.uint8)[None]
            alone += language.label(net, window)[: len(part), :, 0].sum(axis=0)
        assert np.allclose(row, alone / len(text), atol=1e-5) and abs(row.sum() - 1) < 1e-4


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").where("lang IS NOT NULL")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nulls_no_letters_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "abc"), (4, "abc"), (None, "é"), (6, "word " * 30_000)]
    docs = frame(spark, rows)
    net = language.train([b"abc word ", "é à".encode()], ["en", "fr"], rounds=10)
    found = language.identify(docs, net)
    assert {(r["document"]["score"], r["document"]["key"]) for r in found.collect()} == {(0.5, "k")}
    got = found.select("document.doc_id", "lang_pred", "score").collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(r["lang_pred"] in ("en", "fr") for r in got if r["doc_id"] not in (1, 2, 3))
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 4}) == 1
    from pyspark.sql import functions as F

    assert language.fit_language(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), net).count() == 0


def test_what_is_learned_from_is_bounded(spark, monkeypatch):
    given = []
    monkeypatch.setattr(language, "train", lambda texts, languages: given.append((texts, languages)))
    rows = [(1, f"word number {i % 5}", "en") for i in range(4000)] + [(2, "x" * (language.LONGEST + 1), "en"), (3, "mot é", "fr"), (3, "mot é", "fr"), (4, "123", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit_language(docs)
    assert given == [([b"word number 0", "mot é".encode()], ["en", "fr"])]
