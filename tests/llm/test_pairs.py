"""Near duplicates and neighbour search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import ann, graph, jaccard


def brute_components(rows, size, percent):
    """doc_id -> (set size, smallest reachable doc_id), all pairs compared."""
    sets = {}
    for i, text in rows:
        w = jaccard.words_of(text)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                part[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(seed, copies, length, edits):
    """An original and copies with a few words replaced each, so that links are near the threshold."""
    rng = np.random.default_rng(seed)
    words = [f"w{seed}x{i}" for i in range(length)]
    yield " ".join(words)
    for c in range(copies):
        mine = list(words)
        for at in rng.integers(0, length, rng.integers(1, edits + 1)):
            mine[at] = f"e{c}"
        yield " ".join(mine)


@pytest.mark.parametrize(("size", "percent", "screen"), [(3, 90, False), (3, 90, True), (5, 80, False), (5, 80, True)])
def test_components(spark, size, percent, screen):
    texts = [t for s, (n, length, e) in enumerate([(60, 150, 6), (12, 12, 1), (8, 700, 40), (5, 4, 1)]) for t in family(s, n, length, e)]
    texts += [None, "", " \n", "One", "one", "ONE two", "Été a b", "été a b", texts[0], texts[0].upper(), "a b c " * 4000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[0], (None, "a b c")], "doc_id long, text string").withColumn("class", F.lit(1))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, size, percent, screen).collect()}
    assert found == brute_components(rows, size, percent)
    kept = jaccard.drop_near_duplicates(df, size, percent, screen)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, c in found.values()})
    assert kept.where("doc_id IS NULL").count() == 1


def test_repeated_id_with_other_text(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "x y"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df).collect()) == [(1, 2, 1), (2, 2, 1)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("screen", [False, True])
def test_repeated_id_does_not_silence_others(spark, screen):
    """Id 1 holds the text of 2 and a longer one, which stands for it; 2 still meets its near copy 3."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, " ".join(f"x{i}" for i in range(90))), (2, text), (3, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df, screen=screen).collect()} == {1: 1, 2: 2, 3: 2}


def test_links_of_the_last_step(spark, monkeypatch):
    """Small tiles, no neighbours looked at first: groups that link only in the last step come out whole, and nothing else does."""
    monkeypatch.setattr(jaccard, "TILE", 7)
    monkeypatch.setattr(jaccard, "_nearest_pairs", lambda mixed, percent, reach=None: mixed.limit(0).selectExpr("class AS a", "class AS b"))
    texts = [t for s, (n, length, e) in enumerate([(40, 150, 9), (30, 60, 5), (3, 400, 30)]) for t in family(s, n, length, e)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 90), (5, 80)):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, size, percent).collect()}
        assert found == brute_components(rows, size, percent)


@pytest.mark.parametrize("most", [3, 50, 2000])
def test_shared_signatures_are_streamed(spark, most):
    """Signatures that cross batches, repeated rows, and signatures of one set only."""
    rng = np.random.default_rng(most)
    rows = [(int(m), int(s)) for m, s in zip(rng.integers(0, most, 3000), rng.integers(-most, most, 3000))]
    sets: dict[int, set[int]] = {}
    for mark, sig in rows:
        sets.setdefault(sig, set()).add(mark)
    size, key = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        got = [(r["sig"], r["mark64"]) for r in jaccard._met(spark.createDataFrame(rows, "mark64 long, sig long")).collect()]
    finally:
        spark.conf.set(key, size)
    assert sorted(got) == sorted((s, m) for s, marks in sets.items() if len(marks) > 1 for m in marks)


def test_screen_keeps_what_may_link(spark):
    texts = [*family(1, 3, 200, 2), *family(2, 0, 300, 1), *family(3, 0, 5, 1)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[4]])), "doc_id long, text string")
    signed = jaccard._profiles(df, 5, jaccard.screened_share(80)).cache()
    classes = signed.groupBy("mark").agg(F.min("doc_id").alias("class"), F.max("n_shingles").alias("n"))
    found = {r["doc_id"] for r in jaccard._screened(signed, classes, 80).collect()}
    assert {0, 1, 2, 3} <= found and 4 not in found


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_never_miss(percent):
    rng = np.random.default_rng(3)
    for n in [1, 5, 9, 10, 11, 14, 15, 16, 21, 22, 33, 100, 511, 1200]:
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = rng.integers(0, n // 6 + 2)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, rng.integers(0, n // 8 + 2)).astype(np.uint64)])
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if len(a) != len(b) or common != len(a):
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert set(jaccard.signatures(a, percent).tolist()) & set(jaccard.signatures(b, percent).tolist())


def test_sketch_never_overstates():
    rng = np.random.default_rng(5)
    for n in (1, 10, 300, 3000):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in "ab")
        b[: n // 2] = a[: n // 2]
        x, y = jaccard.parity_sketch(np.unique(a)), jaccard.parity_sketch(np.unique(b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def exact(vectors, k):
    """query -> ids by inner product; ``vectors`` maps ids to arrays."""
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % 20 == 0):
        s = m @ vectors[q]
        order = sorted((-v, i) for v, i in zip(s, ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    crowd = rng.normal(size=16)
    rows = {i: rng.normal(size=16) * rng.uniform(0.5, 2) for i in range(600)}
    rows |= {i: crowd + rng.normal(size=16) * 0.01 for i in range(600, 900)}  # near copies
    rows |= {i: rows[7] for i in range(900, 1000)}  # exact copies
    data = [(i, v.tolist(), 0) for i, v in rows.items()]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [float("inf")] + [1.0] * 15, 0), (2080, [None] * 16, 0), (None, [1.0] * 16, 0), (2100, [1.0, 2.0], 0)]
    df = spark.createDataFrame([*data, data[3], *odd], "vec_id long, embedding array<double>, score int")
    found = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, shard_rows=300).collect()
    want, got = exact(rows, 20), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), rel=1e-12)
    assert set(got) == set(want) and all(len(v) == 20 and q not in v for q, v in got.items())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    copies = [i for i in got[900] if i == 7 or 900 < i < 1000]
    assert copies and copies == [7, *range(901, 1000)][: len(copies)]  # ties go to the smaller id
    few = ann.nearest_neighbours(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [r["vec_id"] for r in few] and len(few) == 2
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, shard_rows=200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, 20)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_every_point_is_reachable():
    points = graph.levelled(np.vstack([np.random.default_rng(0).normal(size=(50, 4)) * 1e-6 + 1, np.random.default_rng(1).normal(size=(50, 4))]))
    g, starts = graph.build(points, degree=4, beam=8)
    assert len(graph._all_reachable(points, g, starts)) == len(starts)
