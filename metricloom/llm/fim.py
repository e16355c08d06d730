"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put into another order, by displacement scatter.

All texts of a batch lie in one byte array. Cuts at line ends divide each into three segments, and each
segment moves as a whole: the difference array holds, at the first byte of every segment, how much its
shift differs from that of the segment before it. The cumulative sum gives every byte its shift, and one
numpy scatter writes all outputs of the batch. Going back, the sentinels of an output give its segments,
and one gather with the inverse shifts rebuilds the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import fresh, quoted

SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
BATCH_BYTES = 8_000_000

# The sentinels of prefix, suffix and middle, all of one length.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WIDTH = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")


@dataclass
class Packed:
    """Texts one after another: text i is ``data[edges[i]:edges[i + 1]]``."""

    data: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Packed:
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)])

    def texts(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.edges[:-1], self.edges[1:])]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on seed and id only; a null id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def line_ends(packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(ends, first): places behind each line of all texts in order, and per text the number of its first line."""
    data, edges = packed.data, packed.edges
    ends = np.flatnonzero(data == 10) + 1
    filled = edges[1:] > edges[:-1]
    open_end = np.zeros(len(filled), bool)
    open_end[filled] = data[edges[1:][filled] - 1] != 10
    ends = np.sort(np.r_[ends, edges[1:][open_end]])
    return ends, np.searchsorted(ends, edges, "right")


def cut(packed: Packed, numbers: np.ndarray, plain: np.ndarray, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, form, p, q): lines and form of each text, and the places where its prefix and its middle end."""
    ends, first = line_ends(packed)
    n = np.diff(first)
    form = np.where(plain | (n == 0) | (numbers[:, 2] % 100 >= fim_percent), PLAIN, np.where(numbers[:, 3] % 100 < spm_percent, SPM, PSM))
    a, b = numbers[:, 0] % (n + 1), numbers[:, 1] % (n + 1)
    behind = np.r_[0, ends]
    places = [np.where(k == 0, packed.edges[:-1], behind[first[:-1] + k]) for k in (np.minimum(a, b), np.maximum(a, b))]
    return n, form, *places


def _starts(form: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix begin in an output, from their lengths."""
    psm, spm = form == PSM, form == SPM
    at_prefix = np.where(spm, WIDTH + suffix + WIDTH, np.where(psm, WIDTH, 0))
    at_middle = np.where(form == PLAIN, prefix, prefix + suffix + 3 * WIDTH)
    at_suffix = np.where(spm, WIDTH, np.where(psm, prefix + 2 * WIDTH, prefix + middle))
    return at_prefix, at_middle, at_suffix


def _shifts(total: int, begins: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Shift of every byte: segments beginning at ``begins`` (in order) go to ``targets``; empty segments move nothing."""
    steps = np.zeros(total + 1, np.int64)
    moves = targets - begins
    np.add.at(steps, begins, np.diff(moves, prepend=0))
    return np.cumsum(steps[:-1])


def _segments(begin: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.stack([begin, p, q], axis=1).ravel()


def transform(packed: Packed, form: np.ndarray, p: np.ndarray, q: np.ndarray) -> Packed:
    """Outputs of all texts, by one scatter."""
    begin, end = packed.edges[:-1], packed.edges[1:]
    lengths = (p - begin, q - p, end - q)
    size = end - begin + np.where(form == PLAIN, 0, 3 * WIDTH)
    edges = np.r_[0, np.cumsum(size, dtype=np.int64)]
    at = [edges[:-1] + s for s in _starts(form, *lengths)]
    out = np.empty(edges[-1], np.uint8)
    places = _shifts(len(packed.data), _segments(begin, p, q), _segments(*at))
    places += np.arange(len(packed.data))
    out[places] = packed.data
    moved = form != PLAIN
    for mark, start in ((PREFIX, at[0]), (MIDDLE, at[1]), (SUFFIX, at[2])):
        for i, byte in enumerate(mark):
            out[start[moved] - WIDTH + i] = byte
    return Packed(out, edges)


def _marks(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Places of a sentinel."""
    at = np.flatnonzero(data == mark[0])
    at = at[at <= len(data) - WIDTH]
    for i in range(1, WIDTH):
        at = at[data[at + i] == mark[i]]
    return at


def restore(outputs: Packed, form: np.ndarray) -> Packed:
    """The texts, from outputs and forms alone: sentinels give the segments, one gather brings them back."""
    moved = np.flatnonzero(form != PLAIN)
    begin, end = outputs.edges[:-1], outputs.edges[1:]
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = _marks(outputs.data, mark)
        first = np.searchsorted(at, begin[moved])  # a moved output holds each sentinel once
        place[mark] = at[first] if len(moved) else at[:0]
    spm = form[moved] == SPM
    prefix, middle, suffix = begin.copy(), end.copy(), end.copy()
    ends = (end.copy(), end.copy(), end.copy())
    prefix[moved], middle[moved], suffix[moved] = (place[m] + WIDTH for m in (PREFIX, MIDDLE, SUFFIX))
    ends[0][moved] = np.where(spm, place[MIDDLE], place[SUFFIX])
    ends[2][moved] = np.where(spm, place[PREFIX], place[MIDDLE])
    lengths = (ends[0] - prefix, ends[1] - middle, ends[2] - suffix)
    size = sum(lengths)
    edges = np.r_[0, np.cumsum(size, dtype=np.int64)]
    starts = _segments(edges[:-1], edges[:-1] + lengths[0], edges[:-1] + lengths[0] + lengths[1])
    sources = _shifts(int(edges[-1]), starts, _segments(prefix, middle, suffix))
    sources += np.arange(edges[-1])
    return Packed(outputs.data[sources], edges)


def characters(packed: Packed, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between places: bytes that do not continue one."""
    before = np.r_[0, np.cumsum((packed.data & 0xC0) != 0x80, dtype=np.int64)]
    return before[end] - before[begin]


def _portions(texts: list[bytes], limit: int) -> Iterator[slice]:
    """Slices of about ``limit`` bytes; a longer text is one alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield slice(begin, len(texts))


def rearranged(ids: list[int | None], texts: list[bytes], seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, list]:
    """Columns for one portion of texts: n, form, output, prefix_chars, middle_chars, and the text rebuilt from the output."""
    packed = Packed.of(texts)
    numbers = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    held = np.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], bool)
    n, form, p, q = cut(packed, numbers, held, fim_percent, spm_percent)
    outputs = transform(packed, form, p, q)
    whole = form == PLAIN

    def counted(begin: np.ndarray, end: np.ndarray) -> list[int | None]:
        return [None if w else int(x) for w, x in zip(whole, characters(packed, begin, end))]

    return {
        "n": n.tolist(),
        "form": [FORMS[f] for f in form],
        "output": outputs.texts(),
        "prefix_chars": counted(packed.edges[:-1], p),
        "middle_chars": counted(p, q),
        "restored": restore(outputs, form).texts(),
    }


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    digests: bool = False,
) -> DataFrame:
    """``docs`` with a struct ``fim``: n, form, output, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Each whole text is cut at line ends; where depends on ``seed`` and the document's id alone, so repeated
    rows give equal outputs and no order of rows matters. A null id counts as an empty one. Null texts are
    empty. Empty texts and texts that hold a sentinel stay as they are (``plain``), with null lengths.
    Every text is rebuilt from its output; the second digest is that of the rebuilt one. ``digests`` leaves
    the output itself out. Other columns stay untouched; a column called ``fim`` keeps its name and the
    new one gets underscores. No rows move between partitions.
    """
    fields = "n long, form string, " + ("" if digests else "output string, ") + "prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    @F.pandas_udf(fields)
    def arrange(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            raw = [(t or "").encode() for t in texts]
            keys = [None if k is None or k == "" else int(k) for k in ids]
            parts = []
            for s in _portions(raw, BATCH_BYTES):
                rows = rearranged(keys[s], raw[s], seed, fim_percent, spm_percent)
                outputs, back = rows.pop("output"), rows.pop("restored")
                part = pd.DataFrame(rows).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
                if not digests:
                    part.insert(2, "output", [o.decode() for o in outputs])
                part["output_sha256"] = [hashlib.sha256(o).hexdigest() for o in outputs]
                part["restored_sha256"] = [hashlib.sha256(b).hexdigest() for b in back]
                parts.append(part)
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])

    named = F.coalesce(quoted(key).cast("long").cast("string"), F.lit(""))
    return docs.withColumn(fresh(docs, "fim"), arrange.asNondeterministic()(named, quoted(text)))
