"""Quality rules as a bit ledger: every rule is evaluated once, policies and ablations work on the bits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import WORD_PATTERN, fresh, quoted

MEASURES = (
    "n_words n_chars word_chars n_symbols n_lines n_dup_lines n_repeat_words n_letters n_upper n_marked n_adjacent n_distinct"
).split()
WINDOW = 5

_WORD = re.compile(WORD_PATTERN)
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds twice or more, the first included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    seen, again = set(), set()
    for g in grams:
        if g in seen:
            again.add(g)
        seen.add(g)
    if not again:
        return 0
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if g in again:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``; a null text counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    lines, seen, doubled = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            doubled += _WORD.search(line) is not None
        seen.add(line)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(re.findall("[A-Z]", text))
    return (
        len(words),
        len(text),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        len(lines),
        doubled,
        repeated_words(words),
        letters,
        upper,
        sum(w[-1] in "!?" for w in words),
        sum(a == b for a, b in zip(words, words[1:])),
        len(set(words)),
    )


def _measures() -> Column:
    schema = ", ".join(f"{m} long" for m in MEASURES)

    @F.pandas_udf(schema)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure_text(t) for t in texts], columns=MEASURES, dtype="int64")

    return measure.asNondeterministic()  # never computed twice


@dataclass(frozen=True)
class Rule:
    """A named test; true means the text fails it. Its place in ``RULES`` is its bit."""

    name: str
    fails: str


# The bit of a rule never changes: new rules are appended.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("doubled_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", "n_letters >= 20 AND 2 * n_upper > n_letters"),
    Rule("shouting", "n_words >= 10 AND 10 * n_marked > 3 * n_words"),
    Rule("stutter", "5 * n_adjacent > n_words"),
    Rule("few_distinct", "n_words >= 100 AND 20 * n_distinct < n_words"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)

BASE = ("few_words", "repeated_windows")
# Versioned policies: names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "doubled_lines"),
    "web-2": tuple(r.name for r in RULES),
}
PRODUCTION = "web-2"


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, at: str = "_ledger") -> DataFrame:
    """``docs`` with a struct column ``at``: the measurements and ``fail_bits``.

    Each text is read once and whole; no shuffle. A null or empty text has all
    measurements 0 but ``n_lines`` 1 (its one empty line). A column of the
    name ``at`` would be replaced, others never matter.
    """
    docs = docs.withColumn(at, _measures()(quoted(text)))
    inside = [F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{at}`.\1", f"({r.fails})")) for r in rules]
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(inside)), F.lit(0).cast("long"))
    return docs.withColumn(at, quoted(at).withField("fail_bits", bits))


def passes(bits: Column, policy: str = PRODUCTION, policies: Mapping[str, Sequence[str]] = POLICIES) -> Column:
    """Whether a text with these failure bits is kept by the policy."""
    return bits.bitwiseAND(F.lit(mask(policies[policy]))) == 0


def keep(docs: DataFrame, text: str = "text", policy: str = PRODUCTION) -> DataFrame:
    """The rows a policy keeps, with the columns they came with. Null and empty texts fail ``few_words``."""
    at = fresh(docs, "_ledger")
    checked = ledger(docs, text, at=at)
    return checked.where(passes(quoted(at)["fail_bits"], policy)).select(*map(quoted, docs.columns))


def ablations(bits: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, column: str = "fail_bits") -> DataFrame:
    """Per policy and rule: texts failing it, failing it alone, kept by the policy, and kept without the rule.

    Works on the counts per distinct bit pattern, at most ``2 ** rules`` rows.
    A policy's rows are there also for an empty ledger, with zeros.
    """
    spark = bits.sparkSession
    wanted = spark.createDataFrame(
        [(p, r, mask(names), mask([r])) for p, names in policies.items() for r in names],
        "policy string, rule string, policy_mask long, rule_mask long",
    )
    patterns = bits.groupBy(quoted(column).alias("bits")).agg(F.count("*").alias("n"))
    hit, rest = F.col("bits").bitwiseAND(F.col("rule_mask")) != 0, F.col("policy_mask").bitwiseAND(F.bitwise_not("rule_mask"))
    others = F.col("bits").bitwiseAND(rest) != 0

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))

    expanded = patterns.withColumn("w", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) for row in wanted.collect()])))
    expanded = expanded.select("bits", "n", "w.*")
    return (
        wanted.join(expanded, ["policy", "rule", "policy_mask", "rule_mask"], "left")
        .groupBy("policy", "rule")
        .agg(
            total(hit).alias("n_fail"),
            total(hit & ~others).alias("n_only"),
            total(F.col("bits").bitwiseAND(F.col("policy_mask")) == 0).alias("n_kept"),
            total(~others).alias("n_kept_without"),
        )
    )
