"""Personal data in text: patterns, previews and nested JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a hit, by kind.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
CONFIDENCE = 0.9

#: Location of hits in a document that could not be read as JSON.
UNREADABLE = "(unreadable)"


_HIT = "array<struct<pii_type:string,value:string>>"


def _needs(text: Column) -> dict[str, Column]:
    """What a text must hold for a pattern to match at all; cheap to test."""
    four_digits = text.rlike("[0-9]{4}")
    return {
        "email": text.contains("@"),
        "phone": four_digits,
        "ssn": four_digits,
        "credit_card": four_digits,
        "ip_address": text.rlike("[0-9][.][0-9]"),
    }


#: The shortest end of a phone, social security or card number. Inside JSON its separator may be an escape.
_NUMBER_END = r"[0-9]{2}(?:[-.\s]|\\[fnrt])?[0-9]{4}"


def may_hit(text: Column) -> Column:
    """False only for texts (plain or as JSON) without any hit.

    Numbers and settings of a JSON document are too short to pass, so only documents that hold something like a
    hit reach a parser. In JSON any character may be written as its code, so such escapes count as well.
    """
    return (
        text.contains("@")
        | text.rlike(_NUMBER_END)
        | text.rlike("[0-9][.][0-9]{1,3}[.][0-9]")
        | text.contains("\\u")
    )


def hits(text: Column) -> Column:
    """All hits in a text as ``array<struct<pii_type, value>>``."""
    needs = _needs(text)

    def of_kind(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.transform(
            found, lambda v: F.struct(F.lit(kind).alias("pii_type"), v.alias("value"))
        )
        return F.when(needs[kind], pairs).otherwise(F.array().cast(_HIT))

    return F.concat(*[of_kind(kind, pattern) for kind, pattern in PATTERNS.items()])


def preview(kind: Column, value: Column) -> Column:
    """The hit with most characters hidden."""
    length = F.length(value)
    parts = F.split(value, "@")
    email = F.when(
        F.size(parts) == 2,
        F.concat(F.substring(parts[0], 1, 2), F.lit("***@"), parts[1]),
    ).otherwise("***")
    tail4 = F.right(value, F.lit(4))
    middle = F.concat(
        F.left(value, F.lit(2)),
        F.repeat(F.lit("*"), F.greatest(length - 4, F.lit(0))),
        F.right(value, F.lit(2)),
    )
    return (
        F.when(length <= 4, "****")
        .when(kind == "email", email)
        .when(kind == "credit_card", F.concat(F.lit("****-****-****-"), tail4))
        .when(kind == "ssn", F.concat(F.lit("***-**-"), tail4))
        .otherwise(middle)
    )


#: Characters and rows of a piece of strings on its way out of a Python worker.
PIECE_CHARS, PIECE_ROWS = 1_000_000, 10_000


def _strings(node: dict, path: str) -> Iterator[dict]:
    """String leaves below an object; lists are entered one level deep."""
    for key, child in node.items():
        here = f"{path}.{key}" if path else key
        items = enumerate(child) if isinstance(child, list) else [(None, child)]
        for i, item in items:
            place = here if i is None else f"{here}[{i}]"
            if isinstance(item, str):
                yield {"path": place, "text": item}
            elif isinstance(item, dict):
                yield from _strings(item, place)


def _leaves(document: str | None) -> list[dict]:
    """The strings of one document."""
    try:
        parsed = json.loads(document) if document else {}
        if isinstance(parsed, dict):
            return list(_strings(parsed, ""))
    except (ValueError, RecursionError):
        pass
    return [{"path": UNREADABLE, "text": document}]


def string_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id columns, path and text of every string of the documents in the last column, in pieces of bounded size.

    One document is parsed at a time, so beside an Arrow batch only a piece and a document are in memory.
    """
    for batch in batches:
        *ids, documents = batch.columns
        names = [*batch.schema.names[:-1], "location", "text"]
        rows, paths, texts, chars = [], [], [], 0

        def piece() -> pa.RecordBatch:
            own = [c.take(pa.array(rows, pa.int64())) for c in ids]
            return pa.RecordBatch.from_arrays([*own, pa.array(paths, documents.type), pa.array(texts, documents.type)], names)

        for row, document in enumerate(documents):
            for leaf in _leaves(document.as_py()):
                rows.append(row)
                paths.append(leaf["path"])
                texts.append(leaf["text"])
                chars += len(leaf["path"]) + len(leaf["text"] or "")
                if chars >= PIECE_CHARS or len(rows) >= PIECE_ROWS:
                    yield piece()
                    rows, paths, texts, chars = [], [], [], 0
        if rows:
            yield piece()


def json_strings(df: DataFrame, ids: Sequence[str], document: str) -> DataFrame:
    """Every string inside JSON objects with its path, such as ``a.b[2].c``: rows of ids, location and text.

    The nesting depth is open, which built-in functions cannot follow. A document that is no JSON object,
    or nested deeper than a parser goes, is one string at :data:`UNREADABLE`, so that its text is still scanned.
    """
    chosen = df.select(*ids, document)
    found = [T.StructField("location", T.StringType()), T.StructField("text", T.StringType())]
    return chosen.mapInArrow(string_pieces, T.StructType([*chosen.schema.fields[:-1], *found]))
