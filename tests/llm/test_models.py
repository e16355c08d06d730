"""Toxicity and language: held-out accuracy and odd texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import langid, toxicity
from metricloom.llm.queries import REGISTRY

BIG = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    found = REGISTRY["op1_toxicity"].run(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = np.mean([r["predicted"] == r["toxic"] for r in found])
    assert hit >= 0.9 and all(0 <= r["score"] <= 1 for r in found)


def test_interaction_is_learned():
    """Neither term alone is toxic, both together are: weights alone cannot say that."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([x for x, on in ((1, a), (2, b)) if on] + [int(rng.integers(10, 20))], np.int32))
        labels.append(a & b)
    old, toxicity.MIN_Z = toxicity.MIN_Z, 0.0
    try:
        m = toxicity.train(rows, np.array(labels), epochs=30)
    finally:
        toxicity.MIN_Z = old
    scores = [m.score(np.array(t, np.int32)) for t in ([1, 2, 12], [1, 12], [2, 12], [12])]
    assert scores[0] > 0.8 and max(scores[1:]) < 0.3


def test_neutral_partner_is_learned():
    """Term 2 is as frequent in both classes: with 1 it is toxic, 3 is toxic without it. Settings are the registered ones."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(4000):
        marked, neutral, first = rng.integers(0, 2, 3)
        own = [x for x, on in ((1, marked and first), (2, neutral), (3, marked and not first)) if on]
        rows.append(np.unique(np.array([*own, *rng.integers(10, 60, 8)], np.int32)))
        labels.append(int(marked and neutral == first))
    m = toxicity.train(rows, np.array(labels))
    assert 2 in m.terms
    toxic = [m.score(np.array(t, np.int32)) for t in ([1, 2, 12], [3, 12])]
    clean = [m.score(np.array(t, np.int32)) for t in ([1, 12], [2, 3, 12], [2, 12], [12])]
    assert min(toxic) > 0.8 and max(clean) < 0.3


ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !?"), (5, "idiot " * 50_000), (6, "\U0001f600"), (6, "\U0001f600"), (None, "the")]


def test_odd_texts(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"terms": F.lit(0), "lang": F.lit("mine")})
    docs = spark.read.parquet(f"{BIG}/documents.parquet").join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id")
    model = toxicity.fit(docs.withColumn("label", F.col("toxic")))
    scored = toxicity.score(odd, model, at="s").collect()
    assert len(scored) == len(ODD) and all(0 <= r["s"] <= 1 for r in scored)
    assert next(r["s"] for r in scored if r["doc_id"] == 5) > 0.5
    langs = langid.fit(docs)
    found = {r["doc_id"]: r["l"] for r in langid.identify(odd, langs, at="l").collect()}
    assert {i: found[i]["lang"] for i in (1, 2, 3, 4, 6)} == dict.fromkeys((1, 2, 3, 4, 6), "und")
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert toxicity.score(odd.limit(0), model, at="s").count() == langid.identify(odd.limit(0), langs, at="l").count() == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label int, lang string")
    assert toxicity.fit(none).score(np.array([1, 2], np.int32)) == pytest.approx(0.5)
    assert langid.fit(none).predict("some text") == ("und", 0.0)
    one = spark.createDataFrame([(1, "some text", 1, "en")], none.schema)
    assert langid.fit(one).predict("other words")[0] == "en"
    assert 0 <= toxicity.fit(one).score(np.array([1], np.int32)) <= 1


def test_language_held_out(spark):
    found = REGISTRY["op7_language"].run(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.97


def test_stretches_lose_no_gram(monkeypatch):
    text = "the quick brown fox " * 200
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.gram_counts(text) == whole).all()


def test_score_is_the_written_out_sum():
    """Bias, weights and every pair's product of factors, one pair at a time."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(np.int32) for _ in range(600)]
    m = toxicity.train(rows, np.array([int(3 in r and 5 in r or 7 in r) for r in rows]))
    assert len(m.terms) > 2
    place = {int(t): i for i, t in enumerate(m.terms)}
    for r in rows[:100]:
        known = [place[int(t)] for t in r if int(t) in place]
        z = m.bias + sum(float(m.weights[i]) for i in known)
        z += sum(float(m.factors[i, f]) * float(m.factors[j, f]) for k, i in enumerate(known) for j in known[:k] for f in range(m.factors.shape[1]))
        assert m.score(r) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_training_rows(spark):
    """Labels beside or among the documents give one model; repeated rows count once, and one id with many texts stays within the bound."""
    rows = [(i, f"insult{i % 2} word{i % 7} more", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows] + [(5, 1)] * 50 + [(900, 1), (6, None)], "doc_id long, label int")
    beside = toxicity.fit(docs, labels)
    among = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    terms = np.empty(0, np.int32)
    assert beside.bias == among.bias and (beside.weights == among.weights).all() and beside.score(terms) == among.score(terms)
    crowd = spark.createDataFrame([(1, f"text {i}", i % 2) for i in range(500)], "doc_id long, text string, label int")
    assert 0 <= toxicity.fit(crowd, sample_rows=20).score(terms) <= 1
