"""The whole pipeline against a brute-force version, and every stage on odd documents."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from metricloom.llm import quality, tokens
from metricloom.llm.queries import CLEANED_SQL, boilerplate_ctes, rates_ctes
from test_pairs import brute_components


def plain_pipeline(folder):
    """doc_ids and texts that reach the packing, step by step without Spark."""
    db = duckdb.connect()
    docs = db.execute(f"SELECT * FROM '{folder}/documents.parquet'").df()
    rules = [r.fails.replace(" AND ", " and ").replace(" OR ", " or ") for r in quality.RULES]
    kept = docs[[not any(eval(f, dict(zip(quality.MEASURES, quality.measure_text(t)))) for f in rules) for t in docs["text"]]]  # noqa: S307
    db.register("kept", kept)
    cleaned = db.execute(f"WITH {boilerplate_ctes('kept')} SELECT doc_id, {CLEANED_SQL} AS text, lang, source FROM kept LEFT JOIN site_marks USING (source)").df()
    found = brute_components(list(zip(cleaned["doc_id"], cleaned["text"])), 5, 80)
    single = cleaned[[found[i][1] == i for i in cleaned["doc_id"]]]
    db.register("single", single)
    mixed = db.execute(f"WITH {rates_ctes('single')} SELECT doc_id, text FROM mixed WHERE mix_kept").fetchall()
    return dict(mixed)


def test_same_as_plain(spark, small):
    want = plain_pipeline(small)
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    lengths = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(tokens.token_ids(t)) for i, t in want.items()}
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b " * 40_000, "en", "s", 9), (None, "words enough to be kept by all the rules there are", "en", None, 5), (4, "words enough to be kept by all the rules there are", "en", "s", 5), (4, "words enough to be kept by all the rules there are", "en", "s", 5)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, small, name, stage):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        out = stage(spark, part, small)
        if name != "packing":
            assert out.columns == docs.columns
        n = out.count()
        assert n <= len(ODD) if name != "packing" else n >= part.count()


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixture", "packing"]
