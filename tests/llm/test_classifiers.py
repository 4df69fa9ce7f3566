"""Toxicity, language and quality: what they learn, and the odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import common, langid, quality, toxicity
from tests.llm.cases import clashing, frame, odd_rows, part, prose

WORDS = {
    "aa": [a + b for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti", "vu")],
    "bb": [a + b for a in ("sch", "ung", "ein", "cht") for b in ("er", "en", "ig", "st")],
}


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def odd(spark):
    return clashing(frame(spark, odd_rows(), "doc_id long, text string, lang string"))


def test_nn_pu_finds_marked_words_without_negative_labels(spark):
    rng = random.Random(1)
    rows, toxic, labels = [], set(), []
    for i in range(900):
        text = prose(rng, WORDS["aa"], 30)
        if i % 4 == 0:
            text += " " + rng.choice(["vilo", "garo", "pezu"])
            toxic.add(i)
        rows.append((i, text))
        # A third of the toxic texts are confirmed, none of the others is labelled clean.
        if i % 4 == 0 and i % 3 == 0:
            labels.append((i, 1))
        elif i % 12 == 1:
            labels.append((i, 0))
    docs = frame(spark, rows)
    model = toxicity.fit(docs, frame(spark, labels, "doc_id long, toxic int"), p=toxicity.Params(positives=200, unlabelled=400, prior=0.25))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    right = sum((got[i] >= 0.5) == (i in toxic) for i in got)
    assert right / len(got) > 0.97


def test_toxicity_reads_only_open_labels(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, WORDS["aa"], 20)) for i in range(60)]
    labels = [(i, int(part(i, 5) == 0)) for i in range(60)]
    model = toxicity.fit(frame(spark, rows), frame(spark, labels, "doc_id long, toxic int"))
    assert not len(model.keys) and toxicity.common.sigmoid(np.array([model.bias]))[0] < 1e-6


def test_language_is_learnt_and_letterless_texts_are_unknown(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, WORDS[k], 12), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = docs.select("doc_id", "lang", langid.identify(F.col("text"), model).alias("p")).collect()
    held = [r for r in got if part(r["doc_id"], 4) == 2]
    assert held and all(r["p"]["lang"] == r["lang"] and not r["p"]["rejected"] for r in held)
    strange = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "\n")]).select(langid.identify(F.col("text"), model).alias("p")).collect()
    assert {(r["p"]["lang"], r["p"]["score"], r["p"]["rejected"]) for r in strange} == {("und", 0.0, True)}


def test_language_hands_the_memory_of_its_sample_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    docs = frame(spark, [(i, f"some words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ["en"] and calls == [1]


def test_quality_is_learnt_and_calibrated(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        rows.append((i, prose(rng, WORDS["aa"], 40) + "." if good else "### ".join(w.upper() for w in prose(rng, WORDS["bb"], 40).split())))
        if i % 5:
            labels.append((i, int(good)))
    docs = frame(spark, rows)
    model = quality.fit(docs, frame(spark, labels, "doc_id long, quality int"))
    got = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in got]) > 0.97
    assert all(0 <= r["s"] <= 1 for r in got)


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    docs = frame(spark, [(i, prose(rng, WORDS["aa" if i % 2 else "bb"], 5 + i % 7)) for i in range(120)])
    labels = frame(spark, [(i, i % 2) for i in range(120)], "doc_id long, quality int")
    one, many = quality.fit(docs.repartition(1), labels), quality.fit(docs.repartition(9), labels)
    assert np.allclose(one.weights, many.weights, atol=1e-6)


def test_odd_rows_and_empty_tables(spark):
    docs, none = odd(spark), frame(spark, [], "doc_id long, text string, lang string")
    marks = frame(spark, [(5, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, toxic int, quality int")
    no_marks = marks.limit(0)
    for d in (docs, none):
        for m in (marks, no_marks):
            t, q, la = toxicity.fit(d, m), quality.fit(d, m), langid.fit(d)
            rows = docs.select(toxicity.score(F.col("text"), t).alias("t"), quality.score(F.col("text"), q).alias("q"), langid.identify(F.col("text"), la).alias("l")).collect()
            assert len(rows) == len(odd_rows())
            assert all(0 <= r["t"] <= 1 and 0 <= r["q"] <= 1 and 0 <= r["l"]["score"] <= 1 for r in rows)


def test_language_means_do_not_depend_on_batches():
    rng = random.Random(6)
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(2 << 15, 2)).astype(np.float32), np.zeros(2))
    texts = [prose(rng, WORDS["aa"], n) for n in (1, 3, 500)] + ["x", "word " * 300_000]
    together = langid._means(texts, model)
    apart = np.vstack([langid._means([t], model) for t in texts])
    assert np.allclose(together, apart, atol=1e-5)
    for text, row in zip(texts, together):
        keys, counts = langid.subwords(text, 15)
        assert np.allclose((counts / counts.sum()) @ model.table[keys], row, atol=1e-4)
