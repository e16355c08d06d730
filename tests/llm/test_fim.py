"""Fill-in-the-middle against plain slicing."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from metricloom.llm import fim


def brute(doc_id, text, fim_percent=100, spm_percent=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(units), "plain", text, None, None
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts():
    rng = random.Random(3)
    pieces = ["a", "é", "\n", "\n\n", "\U0001f600", "<", "P>", "<P", "<S", "M>", "\r", "\x85", " ", "long words "]
    yield from ("", "\n", "\n\n", "no end", "<M> held", "x" * 100_000, "line\n" * 30_000, "<<P\n>S>")
    for _ in range(400):
        yield "".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 5, 40])))


@pytest.mark.parametrize(("fim_percent", "spm_percent"), [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_same_as_slicing(spark, monkeypatch, fim_percent, spm_percent):
    rows = [*enumerate(texts()), (None, "a\nb\nc"), (7_000_000_000, None), (3, "no end"), (3, "no end")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fim int").repartition(3)
    got = fim.fill_in_middle(df, fim_percent=fim_percent, spm_percent=spm_percent)
    assert got.columns == ["doc_id", "text", "fim", "fim_"]
    wanted = sorted((str(i), t or "", *map(str, brute(i, t or "", fim_percent, spm_percent))) for i, t in rows)
    seen = got.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", *(str(r["fim_"][c]) for c in ("n", "form", "output", "prefix_chars", "middle_chars"))) for r in seen) == wanted
    for r in seen:
        assert r["fim_"]["output_sha256"] == hashlib.sha256(r["fim_"]["output"].encode()).hexdigest()
        assert r["fim_"]["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_restore_needs_outputs_and_forms_only():
    rows = [t.encode() for t in texts()]
    made = fim.rearranged(list(range(len(rows))), rows)
    forms = np.array([fim.FORMS.index(f) for f in made["form"]])
    assert fim.restore(fim.Packed.of(made["output"]), forms).texts() == rows
    assert set(made["form"]) == {"plain", "psm", "spm"}


def test_portions_do_not_matter():
    rows = [t.encode() for t in texts()]
    whole = fim.rearranged(list(range(len(rows))), rows)["output"]
    cut = [o for s in fim._portions(rows, 50) for o in fim.rearranged(list(range(len(rows)))[s], rows[s])["output"]]
    assert cut == whole


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
