"""Quality ledger, boilerplate lines and mixture on small tables with every odd case."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import lines, mixing, quality

ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\n", None), (4, "word " * 30_000, "a"), (5, "one two\none two\n", "b"),
    (5, "one two\none two\n", "b"), (None, "x y z q", "b"), (6, "\U0001f600 " * 12, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"_ledger": F.lit(1), "n_words": F.lit("mine"), "kept": F.lit(0), "_marks": F.lit(2), "v0": F.lit(3), "rate": F.lit(4.0)})


def brute_repeat(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeat(words)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB#! \n\t é\U0001f600", max_size=60)))
def test_measures(text):
    m = dict(zip(quality.MEASURES, quality.measure_text(text)))
    words = re.findall(r"[^ \t-\r]+", text or "")
    rows = (text or "").split("\n")
    assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
    assert m["n_symbols"] == (text or "").count("#")
    assert m["n_dup_lines"] == sum(r in rows[:i] for i, r in enumerate(rows) if r.strip(" \t\r\v\f"))
    assert m["n_letters"] == sum(c.isalpha() for c in text or "") and m["n_upper"] == sum(c.isupper() for c in text or "")


def test_ledger_keeps_rows_and_columns(odd):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in kept.collect()) == []  # each odd text breaks a rule
    bits = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(odd, at="l").select("doc_id", "l.fail_bits").collect()}
    few, windows = quality.mask(["few_words"]), quality.mask(["repeated_windows"])
    assert bits[1] & few and bits[2] & few and not bits[4] & few and bits[4] & windows
    assert quality.keep(odd.limit(0)).count() == 0


def test_ablations(spark):
    rules = quality.RULES
    ledger = spark.createDataFrame([(0,), (1,), (3,), (4,), (4,), (1 << 8,)], "fail_bits long")
    rows = {(r["policy"], r["rule"]): r for r in quality.ablations(ledger).collect()}
    for policy, names in quality.POLICIES.items():
        whole = quality.mask(names)
        for name in names:
            bit, all_bits = quality.mask([name]), [0, 1, 3, 4, 4, 1 << 8]
            r = rows[policy, name]
            assert r["n_fail"] == sum(bool(b & bit) for b in all_bits)
            assert r["n_only"] == sum(b & whole == bit for b in all_bits)
            assert r["n_kept"] == sum(not b & whole for b in all_bits)
            assert r["n_kept_without"] == sum(not b & whole & ~bit for b in all_bits)
    assert len(rows) == sum(map(len, quality.POLICIES.values())) and len(rules) < 63
    assert {r["n_kept"] for r in quality.ablations(ledger.limit(0)).collect()} == {0}


def test_boilerplate(spark, odd):
    pages = [(i, f"menu\nstory {i}\n\nmenu", "s") for i in range(20)] + [(99, "menu", "t"), (98, "menu", None)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in lines.drop_boilerplate(df, "source", report=True).collect()}
    assert out[3]["text"] == "story 3\n" and (out[3]["n_lines"], out[3]["n_dropped"]) == (4, 2)
    assert out[99]["text"] == out[98]["text"] == "menu"  # a small site, and no site
    kept = lines.drop_boilerplate(odd, "source")
    assert kept.columns == odd.columns
    as_rows = lambda d: sorted(map(str, d.collect()))
    assert as_rows(kept) == as_rows(odd)
    assert lines.drop_boilerplate(odd.limit(0), "source").count() == 0
    blank = spark.createDataFrame([(i, "\n \n", "s") for i in range(20)], df.schema)
    assert {r["text"] for r in lines.drop_boilerplate(blank, "source").collect()} == {"\n \n"}
    urls = spark.createDataFrame([("http://A.b/x",), (None,), ("nonsense",)], "url string")
    assert [r[0] for r in urls.select(lines.host_of(F.col("url"))).collect()] == ["a.b", None, None]


def test_copies_are_one_page(spark):
    """A group of exact copies above the ratio: one document keeps the text through both stages."""
    copied = "\n".join(f"line {i} of a text that many rows hold word for word" for i in range(4))
    rows = [(i, copied if i < 30 else f"menu\nstory {i} of its own with words of its own {i * 7}", "en", "s", 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.line_dedup(spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(texts[i] == copied for i in range(30))
    assert all(texts[i].startswith("story") for i in range(30, 100))  # the menu is on 70 of 71 pages
    left = [r["text"] for r in corpus_pipeline.near_duplicates(spark, cleaned, "").collect()]
    assert left.count(copied) == 1 and len(left) == 71 and "" not in left
    few = spark.createDataFrame([(i, "copied" if i < 50 else "copied\nother", "s") for i in range(54)] + [(99, None, "s"), (98, None, "s")], "doc_id long, text string, source string")
    assert lines.boilerplate(few, "source").count() == 0  # on two page texts of three, though on 54 rows


def test_raking_meets_targets(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), "ab"[i % 10 < 3], "xyz"[i % 3]) for i in range(3000)], "doc_id long, text string, source string, lang string"
    )
    targets = {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 2.0, "y": 1.0, "z": 1.0}}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    rates = mixing.fit(docs, F.lit(1), dims, targets=targets).collect()
    total = sum(r["rate"] * r["tokens"] for r in rates)
    share = lambda k, v: sum(r["rate"] * r["tokens"] for r in rates if r[k] == v) / total
    assert share("v0", "a") == pytest.approx(0.5, abs=1e-6) and share("v1", "x") == pytest.approx(0.5, abs=1e-6)
    assert max(r["rate"] for r in rates) == pytest.approx(1)
    report = mixing.mix(docs, dims, F.lit(1), targets=targets, report=True).collect()
    assert len(report) == 3000
    for v in "ab":
        mine = [r for r in report if r["source"] == v]
        assert sum(r["mix_kept"] for r in mine) == pytest.approx(sum(r["mix_rate"] for r in mine), rel=0.1)


def test_mixture_odd(odd):
    dims = {"source": F.col("source"), "form": mixing.text_form(F.col("text"))}
    report = mixing.mix(odd, dims, report=True)
    assert report.count() == len(ODD) and report.where("mix_rate IS NULL").count() == 0
    assert mixing.mix(odd, dims).columns == odd.columns
    five = [r["mix_kept"] for r in report.where("doc_id = 5").collect()]
    assert len(set(five)) == 1
    assert mixing.mix(odd.limit(0), dims).count() == 0
