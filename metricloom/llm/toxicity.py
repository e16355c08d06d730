"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored

BITS = 22
FACTORS = 8
SAMPLE_ROWS = 12_000
MIN_DOCUMENTS = 4
MIN_Z = 4.0
PAIR_Z = 6.0
EPOCHS = 12
STEMS = (4, 5)
_LETTERS = re.compile(r"[^\W\d_]+")


class Terms:
    """Hashed terms of a text: its distinct lower-cased words and their first letters.

    Hashes of words met before are remembered; the memory is emptied when it grows too large.
    """

    def __init__(self, bits: int = BITS, limit: int = 300_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.mask, self.limit = (1 << bits) - 1, limit

    def of(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        if len(known) > self.limit:
            known.clear()
        for w in set(_LETTERS.findall((text or "").lower())):
            h = known.get(w)
            if h is None:
                h = (zlib.crc32(w.encode()) & self.mask, *(zlib.crc32(f"{w[:n]}*".encode()) & self.mask for n in STEMS if len(w) >= n))
                known[w] = h
            out.extend(h)
        return np.unique(np.array(out, np.int32))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <factors, factors>); absent terms count nothing."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        z = self.bias + self.weights[at].sum()
        if len(at):
            v = self.factors[at]
            z += 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _z(have: np.ndarray, toxic: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Standard errors by which the share of each term differs between the ``positive`` toxic and the other rows of ``n``."""
    share = have / n
    gap = toxic / positive - (have - toxic) / (n - positive)
    return np.abs(gap) / np.sqrt(np.maximum(share * (1 - share), 1 / n**2) * (1 / positive + 1 / (n - positive)))


def _partners(kept: np.ndarray, number: np.ndarray, begin: np.ndarray, labels: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """``kept`` and those of ``enough`` rows that tell the classes apart among the rows of a kept term.

    A term may be as frequent in both classes and yet matter next to another; a pair counts from ``MIN_DOCUMENTS`` rows.
    """
    size, place = int(enough.sum()), np.where(enough, np.cumsum(enough) - 1, -1)[number]
    ok = place >= 0
    owner, number = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[ok], place[ok]
    begin = np.searchsorted(owner, np.arange(len(begin)))
    first, by_term = np.r_[0, np.cumsum(np.bincount(number, minlength=size))], np.argsort(number, kind="stable")
    alone = kept[enough]
    added = alone.copy()
    for u in np.flatnonzero(alone):
        at = owner[by_term[first[u] : first[u + 1]]]
        n, positive = len(at), float(labels[at].sum())
        if not 0 < positive < n:
            continue
        toxic, clean = (np.bincount(np.concatenate([number[begin[i] : begin[i + 1]] for i in at[labels[at] == c]]), minlength=size) for c in (1, 0))
        have = toxic + clean
        new = np.flatnonzero(~added & (have >= MIN_DOCUMENTS) & (n - have >= MIN_DOCUMENTS))
        added[new[_z(have[new], toxic[new], positive, n) >= PAIR_Z]] = True
    out = kept.copy()
    out[enough] = added
    return out


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, start: float = 1e-3) -> FactorizationMachine:
    """Fit by AdaGrad on logistic loss, classes weighted equally; terms of fewer than ``MIN_DOCUMENTS`` rows stay out, and
    so do those whose share differs between the classes by less than ``MIN_Z`` standard errors, unless it differs by
    ``PAIR_Z`` among the rows of a term that is in.

    Deterministic for given rows in given order. Without both classes it is a constant: the smoothed share of label 1.
    """
    labels = np.asarray(labels, np.float32)
    n, positive = len(labels), float(labels.sum()) if len(labels) else 0.0
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return FactorizationMachine(float(np.log(share / (1 - share))), np.empty(0, np.int32), np.empty(0, np.float32), np.empty((0, factors), np.float32))
    flat = np.concatenate(rows)
    terms, number = np.unique(flat, return_inverse=True)
    have = np.bincount(number, minlength=len(terms))
    toxic = np.bincount(number, np.repeat(labels, [len(r) for r in rows]), len(terms))
    alone = (have >= MIN_DOCUMENTS) & (_z(have, toxic, positive, n) >= MIN_Z)
    frequent = _partners(alone, number, np.r_[0, np.cumsum([len(r) for r in rows])], labels, have >= MIN_DOCUMENTS)
    if not frequent.any():
        return train(rows, np.zeros(n), factors)
    place = np.where(frequent, np.cumsum(frequent) - 1, -1)[number]
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    ok = place >= 0
    place, owner, terms = place[ok], owner[ok], terms[frequent]
    size, rng = len(terms), np.random.default_rng(7)
    w, v, b = np.zeros(size, np.float32), rng.normal(0, 0.01, (size, factors)).astype(np.float32), 0.0
    gw, gv, gb = np.full(size, start, np.float32), np.full((size, factors), start, np.float32), start
    importance = np.where(labels > 0, n / (2 * positive), n / (2 * (n - positive))).astype(np.float32)
    begin = np.searchsorted(owner, np.arange(n + 1))
    step = 128
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, step):
            batch = order[lo : lo + step]
            count = begin[batch + 1] - begin[batch]
            row = np.repeat(np.arange(len(batch)), count)
            at = place[np.repeat(begin[batch] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
            touched, local = np.unique(at, return_inverse=True)
            vx = v[touched]
            total = np.zeros((len(batch), factors), np.float32)
            square = np.zeros(len(batch), np.float32)
            for f in range(factors):
                column = vx[local, f]
                total[:, f] = np.bincount(row, column, len(batch))
                square += np.bincount(row, column * column, len(batch))
            z = b + np.bincount(row, w[at], len(batch)) + 0.5 * ((total**2).sum(1) - square)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * importance[batch]).astype(np.float32) / len(batch)
            grad = np.bincount(local, g[row], len(touched)).astype(np.float32)
            dw = grad + decay * w[touched]
            gw[touched] += dw**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            for f in range(factors):
                dv = np.bincount(local, g[row] * total[row, f], len(touched)).astype(np.float32) - grad * vx[:, f] + decay * vx[:, f]
                gv[touched, f] += dv**2
                v[touched, f] -= 0.5 * rate * dv / np.sqrt(gv[touched, f])
            gb += float(g.sum()) ** 2
            b -= rate * float(g.sum()) / gb**0.5
    return FactorizationMachine(float(b), terms.astype(np.int32), w, v)


def fit(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Train on at most ``sample_rows`` labelled rows, the ones with the smallest hash of their key.

    Labels are a column of ``docs``, or of ``labels`` under the same key. The bound on the hash is found from keys alone,
    and it filters both tables before they meet: no text above it is moved or looked at. Terms are hashed on the executors. The sample, of
    a bounded number of rows, is trained on in one task, and the model (frequent terms of the sample only) comes back
    to the driver. Rows with a null key, label or text are not used, repeated ones (same key, label and terms) count once; of a key
    with very many texts no more than fit are taken.
    """
    rank = F.xxhash64("key")
    labelled = docs if labels is None else labels
    truth = labelled.select(quoted(key).alias("key"), quoted(label).cast("double").alias("label"), *([quoted(text).alias("text")] if labels is None else []))
    truth = truth.where("key IS NOT NULL AND label IS NOT NULL")
    texts = docs.select(quoted(key).alias("key"), quoted(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    named = truth.where("text IS NOT NULL").select("key") if labels is None else texts.select("key").join(truth.select("key"), "key")
    limit = named.select(rank.alias("rank")).orderBy("rank").limit(sample_rows).agg(F.max("rank")).first()[0]
    low = rank <= F.lit(limit)
    chosen = truth.where("text IS NOT NULL").where(low) if labels is None else texts.where(low).join(truth.where(low), "key")

    @F.pandas_udf("array<int>")
    def terms_of(texts: pd.Series) -> pd.Series:
        terms = Terms()
        return pd.Series([terms.of(t) for t in texts], index=texts.index)

    hashed = chosen.select(rank.alias("rank"), "label", terms_of.asNondeterministic()("text").alias("terms")).distinct()
    sample = stored(hashed.orderBy("rank", "label", F.size("terms"), "terms").limit(sample_rows), "toxicity-sample")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=rows["terms"].map(len)).sort_values(["rank", "label", "size"], kind="stable")
        m = train([np.asarray(t, np.int32) for t in rows["terms"]], rows["label"].to_numpy())
        return pd.DataFrame({"bias": [m.bias], "terms": [m.terms.tobytes()], "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]})

    model = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "bias double, terms binary, weights binary, factors binary").collect()
    if not model:
        return train([], np.empty(0))
    m = model[0]
    factors = np.frombuffer(m["factors"], np.float32).reshape(-1, FACTORS)
    return FactorizationMachine(m["bias"], np.frombuffer(m["terms"], np.int32), np.frombuffer(m["weights"], np.float32), factors)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", at: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (0 to 1); null and empty texts get that of no terms."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            yield pd.Series([model.score(terms.of(t)) for t in texts], dtype="float64")

    return docs.withColumn(at, scores.asNondeterministic()(quoted(text)))
