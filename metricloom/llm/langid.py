"""Language identification in two steps: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import itertools
import pickle
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored

BITS = 15
SAMPLE_ROWS = 8_000
CHUNK = 200_000
UNKNOWN = "und"

# Families of languages by ISO code. Others are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tt".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn mr ur gu pa ne si".split(),
    "dravidian": "ta te kn ml".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point of the first plane: its lower-case letter, or a blank."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint64)


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed character 1- to 4-grams of the lower-cased letters, other runs being one blank.

    Worked off in stretches of starting places, so memory is bounded and every n-gram is met once.
    """
    counts = np.zeros(1 << bits, np.int64)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 0x10000, _letters()[np.minimum(codes, 0xFFFF)], codes)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    with np.errstate(over="ignore"):
        for lo in range(0, len(codes), CHUNK):
            h, places = np.zeros(min(CHUNK, len(codes) - lo), np.uint64), []
            for n in range(4):
                piece = codes[lo + n : lo + n + len(h)]
                h = h[: len(piece)] * np.uint64(0x9E3779B97F4A7C15) + piece + np.uint64(1)
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                places.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
            counts += np.bincount(np.concatenate(places), minlength=len(counts))
    return counts


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of the n-gram counts, at unit length."""
    value = np.sqrt(gram_counts(text, bits).astype(np.float32))
    return value / np.sqrt(value @ value)


@dataclass
class LinearSvm:
    """sign(w . x + b); trained on hinge loss by averaged stochastic steps."""

    weights: np.ndarray
    bias: float

    def margin(self, value: np.ndarray) -> float:
        return float(self.weights @ value + self.bias)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, bits: int = BITS, epochs: int = 4, strength: float = 1e-4) -> LinearSvm:
    """Pegasos with averaging over the second half; both classes weigh the same."""
    w, b = np.zeros(1 << bits, np.float64), 0.0
    scale, total, total_b, kept = 1.0, np.zeros(1 << bits, np.float64), 0.0, 0
    weight = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (-1, 1)}
    rng, t, steps = np.random.default_rng(11), 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            at, value = rows[i]
            eta = 1 / (strength * (t + 1 / strength))
            y = float(signs[i])
            m = y * (scale * (w[at] @ value) + b)
            scale *= 1 - eta * strength
            if m < 1:
                w[at] += (eta * y * weight[int(y)] / scale) * value
                b += eta * y * weight[int(y)] * 0.1
            if scale < 1e-6:
                w *= scale
                scale = 1.0
            if t > steps // 2 and t % 64 == 0:
                total += scale * w
                total_b += b
                kept += 1
    return LinearSvm((total / kept if kept else scale * w).astype(np.float32), total_b / kept if kept else b)


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(4 * margin, -30, 30))))


@dataclass
class LanguageModel:
    bits: int
    families: dict[str, list[str]]
    of_family: dict[str, LinearSvm] = field(default_factory=dict)
    pairs: dict[tuple[str, str], LinearSvm] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the family with the largest margin, then the most votes among its pairs of languages.

        The score is the chance of the family times the mean chance of the winner in its pairs.
        """
        if not self.families or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        value = features(text, self.bits)
        margins = {f: m.margin(value) for f, m in self.of_family.items()}
        family = max(self.families, key=lambda f: margins.get(f, 0.0)) if margins else next(iter(self.families))
        chance = _chance(margins[family]) if family in margins else 1.0
        languages = self.families[family]
        votes, wins = Counter({x: 0 for x in languages}), {x: [] for x in languages}
        for a, b in itertools.combinations(languages, 2):
            p = _chance(self.pairs[a, b].margin(value))
            votes[a if p >= 0.5 else b] += 1
            wins[a].append(p)
            wins[b].append(1 - p)
        mean = {x: float(np.mean(wins[x])) if wins[x] else 1.0 for x in languages}
        best = max(languages, key=lambda x: (votes[x], mean[x]))
        return best, chance * mean[best]


def train(texts: list[str], langs: list[str], family_of: Mapping[str, str] = FAMILY_OF, bits: int = BITS) -> LanguageModel:
    """A model of the languages met; texts without a letter teach nothing."""
    rows, known = [], []
    for t, x in zip(texts, langs):
        if t and any(map(str.isalpha, t)):
            value = features(t, bits)
            at = np.flatnonzero(value)
            rows.append((at, value[at]))
            known.append(x)
    langs = np.array(known, object)
    families: dict[str, list[str]] = {}
    for x in sorted(set(langs.tolist())):
        families.setdefault(family_of.get(x, x), []).append(x)
    model = LanguageModel(bits, families)
    member = np.array([family_of.get(x, x) for x in langs], object)
    if len(families) > 1:
        for f in families:
            model.of_family[f] = train_svm(rows, np.where(member == f, 1, -1), bits)
    for languages in families.values():
        for a, b in itertools.combinations(languages, 2):
            inside = [i for i, x in enumerate(langs) if x in (a, b)]
            model.pairs[a, b] = train_svm([rows[i] for i in inside], np.where(langs[inside] == a, 1, -1), bits)
    return model


def _at_most(limits: Mapping[str, int]) -> Column:
    """Whether ``rank`` is at most the limit of the row's ``lang``; false for other languages."""
    return F.coalesce(*[F.when((F.col("lang") == x) & (F.col("rank") <= n), F.lit(True)) for x, n in limits.items()], F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, family_of: Mapping[str, str] = FAMILY_OF) -> LanguageModel:
    """Train on at most ``sample_rows`` rows with a language, the same number of each where there are enough.

    The rows of a language with the smallest hash of their key are taken; the bound is split evenly, so
    a rare language is not crowded out. Training runs in one task over this bounded sample. Rows with
    a null key, text or language are not used.
    """
    usable = labelled.where(quoted(key).isNotNull() & quoted(text).isNotNull() & quoted(lang).isNotNull())
    usable = usable.select(F.xxhash64(quoted(key)).alias("rank"), quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("rank").alias("n_ranks"))
    known = {r["lang"]: r["n_ranks"] for r in counts.orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not known:
        return LanguageModel(BITS, {})
    each = max(1, sample_rows // len(known))
    # Hashes are spread evenly: the smallest ones lie below a bound with room for chance and for the error of
    # the distinct count, so that no task ranks all rows of a language.
    bounds = {x: min(1.0, (each + 8 * each**0.5 + 32) / (0.75 * max(1, n))) for x, n in known.items()}
    bounds = {x: min(2**63 - 1, int(share * 2**64) - 2**63) for x, share in bounds.items()}
    low = _at_most(bounds)
    order = Window.partitionBy("lang").orderBy("rank")
    edge = usable.select("rank", "lang").where(low).withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).groupBy("lang").agg(F.max("rank").alias("edge"))
    edges = {r["lang"]: r["edge"] for r in edge.collect()}
    sample = stored(usable.where(_at_most(edges)), "language-sample")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "lang", "text"])
        return pd.DataFrame({"model": [pickle.dumps(train(rows["text"].tolist(), rows["lang"].tolist(), family_of))]})

    return pickle.loads(sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "model binary").first()["model"])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", at: str = "language") -> DataFrame:
    """``docs`` with a struct (``lang``, ``score``) of every whole text; ``und`` with 0 for null texts and texts without a letter."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(at, predict.asNondeterministic()(quoted(text)))
