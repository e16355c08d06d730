"""Token ids of whole texts, and their cutting into pieces that fit a sequence."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import quoted

VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 2
CAPACITY = 1024


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE of that public vocabulary file; loaded once per worker.

    ``byte_bpe_50k.tiktoken`` holds the vocabulary of ``byte_bpe_50k.json`` as ranks: the ids are those
    the ``tokenizers`` library gives for the JSON file by default (a test compares them), at five times its
    speed. Tokens that the JSON file adds keep their ids where a text holds their strings.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole, added = path.removesuffix(".tiktoken") + ".json", {}
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text and the end id; a null text is empty."""
    ids = encoder(vocabulary).encode(text or "", allowed_special="all", disallowed_special=())
    ids.append(end_id)
    return np.array(ids, "<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of ``n`` tokens: full pieces, the first one taking the rest."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document; ids are not kept, nothing is shuffled.

    Every row gives at least one piece (null and empty texts the end id alone). Null keys stay null.
    """

    @F.pandas_udf("array<struct<piece:long,start:long,length:long,ids_crc32:long>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = []
            for t in batch:
                ids = token_ids(t, vocabulary)
                starts = cuts(len(ids), capacity)
                ends = [*starts[1:], len(ids)]
                found.append([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for i, (a, b) in enumerate(zip(starts, ends))])
            yield pd.Series(found, index=batch.index)

    cut_up = docs.select(quoted(key).alias(key), cut.asNondeterministic()(quoted(text)).alias("p"))
    return cut_up.select(quoted(key), F.explode("p").alias("p")).select(quoted(key), "p.*")
