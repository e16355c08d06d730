"""Exact Jaccard self-join of shingle sets by PartEnum signatures, as linked components.

Sets are grouped into bands of sizes. Two sets of a band pair with a similarity of at least the
threshold differ in at most k elements. The feature domain (shingle hashes) is split into groups,
so that in one of them the sets differ in at most one element, and each group into three parts,
so that two parts agree there. A signature names the band, the group, the two parts and what the
set holds in them; all three subsets of two parts are enumerated for every group. Sets that are
similar enough therefore share a signature, with certainty. Spare groups make sure that they also
share one that is not empty, so that sets do not meet for what both lack.

Nothing emits all pairs of a bucket. Equal sets are one class from the start, and of buckets with the
same classes one is kept. Pairs are judged by a parity sketch first: two sets differ in at least as many
elements as their sketches in bits, so a pair it rejects cannot link. Each class meets only its neighbours in
its largest bucket, then the nearest one of another component in any bucket; these are compared by text, and
found links make components. What is left are buckets that still hold several components. There a task says
which classes have a partner across components that the sketch lets pass: no more rows than the bucket has. Buckets with
the same ones are one again, and only their pairs across components that pass are emitted and compared by text. Large buckets are cut into
tiles, which tasks compare two by two. No link between components is lost.

The number of signatures of a set grows with the differences allowed. For lower thresholds a screen
comes first: shingles of a fixed share of the domain are counted, and a set of which more are held by
no other set than a partner may lack cannot link, so it needs no signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import fresh, quoted, stored

SHINGLE = 3
PERCENT = 90
BAND_RATIO = 1.5
SKETCH_WORDS = 8
WIDE_WORDS = 32
WIDE_FROM = 400
BLOCK_CHARS = 8_000_000
ENTRY_ROWS = 200_000
TILE = 1000
TILE_ELEMENTS = 4_000_000
REACH = 16
SCREEN_SHARE = 1.25

_MIX1, _MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit word hashes, remembered for frequent words; forgets all when it grows too large."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z only) words of a whole text."""
    return [w.decode() for w in _word_bytes(text)]


def _word_bytes(text: str | None) -> list[bytes]:
    """The words in UTF-8: on bytes Python lowers A-Z and splits at the ASCII white space only."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; shorter texts are one shingle, wordless ones none."""
    words = _word_bytes(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = min(size, len(h))
    grams = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            grams = _scramble(grams * _MIX3 + h[i : len(h) - n + 1 + i])
    return np.unique(grams)


def band_edges(largest: int, ratio: float = BAND_RATIO) -> list[int]:
    """Lower edges of the size bands, from 1 up to beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return edges


def allowed_difference(largest: int, percent: int = PERCENT) -> int:
    """Most elements in which two sets of at most this size may differ when they reach the similarity."""
    return 2 * largest * (100 - percent) // (100 + percent)


def spare_groups(k: int, smallest: int) -> int:
    """Groups in which a set of the band's smallest size can be expected to lack two of the three parts, and some more."""
    groups = k // 2 + 1
    lacking = np.exp(-smallest / (3 * groups))
    expected = groups * (3 * lacking**2 - 2 * lacking**3)
    return int(np.ceil(expected + 2 * np.sqrt(expected)))


def signatures(elements: np.ndarray, percent: int = PERCENT, ratio: float = BAND_RATIO) -> np.ndarray:
    """PartEnum signatures of one set.

    A set signs for its own band and, when a partner may lie in the next, for that too. Sets of a
    band whose allowed difference is 0 need none: similar ones are equal.

    ``spare`` + 1 groups or more hold at most one difference, and there two parts agree. A set with at
    most ``spare`` groups that have two empty parts so agrees with each partner in two parts that are
    not both empty, and leaves out the signatures of empty parts. Any other set keeps them.
    """
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    edges = band_edges(n * 2, ratio)
    own = int(np.searchsorted(edges, n, "right")) - 1
    found = []
    with np.errstate(over="ignore"):
        scrambled = _scramble(elements * _MIX3)
        for band in (own, own + 1):
            low, high = edges[band], edges[band + 1] - 1
            if band != own and 100 * n < percent * low:
                continue
            k = allowed_difference(high, percent)
            if not k:
                continue
            spare = spare_groups(k, low)
            groups = k // 2 + 1 + spare
            part = (scrambled >> np.uint64(32)) % np.uint64(groups * 3)
            order = np.argsort(part, kind="stable")
            placed = part[order]
            sums = np.zeros(groups * 3, np.uint64)
            start = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
            sums[placed[start].astype(np.int64)] = np.add.reduceat(_scramble(elements[order]), start)
            sums = sums.reshape(groups, 3)
            empty = np.bincount(part.astype(np.int64), minlength=groups * 3).reshape(groups, 3) == 0
            skip = np.count_nonzero(empty.sum(axis=1) > 1) <= spare
            number = np.arange(groups, dtype=np.uint64) + np.uint64(band << 40)
            for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                one = _scramble(_scramble(sums[:, a] + number * _MIX3) + sums[:, b] + np.uint64(i + 1))
                found.append(one[~(empty[:, a] & empty[:, b])] if skip else one)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def parity_sketch(elements: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """64-bit words whose bits say whether an odd number of elements falls in each of their cells."""
    with np.errstate(over="ignore"):
        cells = (_scramble(elements ^ _MIX3) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def sketches(elements: np.ndarray) -> tuple[bytes, bytes | None]:
    """The short sketch, and for sets that would fill it a wide one."""
    return parity_sketch(elements).tobytes(), parity_sketch(elements, WIDE_WORDS).tobytes() if len(elements) > WIDE_FROM else None


def _bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)


def _near_pairs(keys: np.ndarray, part: np.ndarray, n: np.ndarray, tile: np.ndarray, short: np.ndarray, wide: np.ndarray, wide_at: np.ndarray, percent: int, reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, d): places of pairs across parts that may link, in rows of whole buckets in order of their keys (sig, i, j).

    Rows are compared with those 1, 2, 3 ... places further on in the same bucket, all buckets at a time;
    with ``reach`` only so far. ``wide_at`` is -1 where a row has no wide sketch.
    """
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    ends = np.repeat(np.r_[starts[1:], len(keys)], np.diff(np.r_[starts, len(keys)]))
    split = keys[:, 1] != keys[:, 2]
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at) or reach is not None and step > reach:
            return
        x, y = at, at + step
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fit = (part[x] != part[y]) & (100 * small >= percent * large) & (~split[x] | (tile[x] != tile[y]))
        x, y = x[fit], y[fit]
        most = (n[x] + n[y]) * (100 - percent)
        d = _bits_apart(short[x], short[y])
        both = (wide_at[x] >= 0) & (wide_at[y] >= 0)
        d[both] = np.maximum(d[both], _bits_apart(wide[wide_at[x[both]]], wide[wide_at[y[both]]]))
        fit = d * (100 + percent) <= most
        yield x[fit], y[fit], d[fit]
        step += 1


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Keys, parts, sizes, tiles and sketches of ``rows``, as :func:`_near_pairs` takes them."""
    has_wide = np.array([w is not None for w in rows["wide"]], bool)
    short = np.frombuffer(b"".join(rows["short"]), np.uint64).reshape(-1, SKETCH_WORDS)
    wide = np.frombuffer(b"".join(w for w in rows["wide"] if w is not None), np.uint64).reshape(-1, WIDE_WORDS)
    numbers = (rows[c].to_numpy(np.int64) for c in ("part", "n", "tile"))
    return rows[["sig", "i", "j"]].to_numpy(np.int64), *numbers, short, wide, np.where(has_wide, np.cumsum(has_wide) - 1, -1)


def _nearest(rows: pd.DataFrame, percent: int, reach: int | None) -> pd.DataFrame:
    """(a, b, d): the nearest smaller partner of each class of another part."""
    ids = rows["class"].to_numpy(np.int64)
    found = [np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), d]) for x, y, d in _near_pairs(*_columns(rows), percent, reach)]
    a, b, d = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    return pd.DataFrame({"a": a, "b": b, "d": d}).sort_values(["b", "d", "a"]).drop_duplicates("b")


def _suspects(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(sig, i, j, class): those of ``rows`` that have a partner of another part that may link."""
    marked = np.zeros(len(rows), bool)
    for x, y, _ in _near_pairs(*_columns(rows), percent, None):
        marked[x] = marked[y] = True
    return rows.loc[marked, ["sig", "i", "j", "class"]]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(small) + len(large) - common)


def _across(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): all pairs of groups of suspects that may link across parts."""
    rows = rows.assign(sig=rows.groupby(["sig", "i", "j"], sort=False).ngroup(), i=0, j=0, tile=0)  # whatever tiles its classes came from
    ids = rows["class"].to_numpy(np.int64)
    found = [np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]) for x, y, _ in _near_pairs(*_columns(rows), percent, None)]
    a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def _by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on portions of whole buckets of ``rows``, which are dealt and ordered by (sig, i, j) and then size."""
    dealt = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", *(c for c in ("n", "class") if c in rows.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            last = (batch[["sig", "i", "j"]] == batch[["sig", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            rest = batch[last]
            if not last.all():
                yield work(batch[~last])
        if rest is not None:
            yield work(rest)

    return dealt.mapInPandas(run, schema)


def _tiled(mixed: DataFrame, within: bool = False) -> DataFrame:
    """Rows of buckets (sig, class, part, size, weight, n, ...) with ``tile`` and the keys (i, j) of the pairs of tiles they are in.

    A bucket of more than ``TILE`` classes or ``TILE_ELEMENTS`` elements is dealt into tiles. ``within`` leaves each tile to itself.
    """
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("weight") / TILE_ELEMENTS)).cast("long")
    rows = mixed.withColumn("tile", F.pmod(F.xxhash64("class"), tiles))
    other = F.array("tile") if within else F.sequence(F.lit(0).cast("long"), tiles - 1)
    rows = rows.withColumn("other", F.explode(other))
    return rows.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other", "size", "weight")


def _nearest_pairs(mixed: DataFrame, percent: int, reach: int | None = None) -> DataFrame:
    """(a, b): the nearest smaller partner of each class across parts, over all its buckets."""
    pairs = _by_bucket(_tiled(mixed, within=reach is not None), lambda rows: _nearest(rows, percent, reach), "a long, b long, d long")
    return pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b")


def screened_share(percent: int) -> float:
    """Share of the shingle domain that the screen counts: somewhat more than the share a partner may lack."""
    return min(1.0, SCREEN_SHARE * (100 - percent) / 100)


def _profiles(docs: DataFrame, size: int, share: float = 0.0) -> DataFrame:
    """(doc_id, n_shingles, mark, short, wide, counted) of each text's set; ``counted`` are its shingles in that share of the domain."""
    limit = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    @F.pandas_udf("n long, mark binary, short binary, wide binary, counted array<long>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            n, marks, marked, counted = [], [], [], []
            for t in texts:
                s = shingle_set(t, hashes, size)
                n.append(len(s))
                marks.append(_mark(s))
                marked.append(sketches(s))
                counted.append(s[: np.searchsorted(s, limit)].view(np.int64))
            yield pd.DataFrame({"n": pd.array(n, "int64"), "mark": marks, "short": [x for x, _ in marked], "wide": [x for _, x in marked], "counted": counted})

    p = docs.select("doc_id", profile.asNondeterministic()("text").alias("p"))
    return p.select("doc_id", F.col("p.n").alias("n_shingles"), "p.mark", "p.short", "p.wide", "p.counted")


def _screened(signed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id) of the classes that may have a partner.

    A partner of a set of n shingles lacks at most (100 - ``percent``) % of them, so a set with more
    counted shingles of its own than that has none. Copies have one mark and count as one set.
    """
    held = signed.select(F.explode("counted").alias("shingle"), F.xxhash64("mark").alias("key"))
    held = held.groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    own = held.where("key = last").groupBy("key").agg(F.count("*").alias("own"))
    known = classes.withColumn("key", F.xxhash64("mark")).join(own, "key", "left")
    return known.where(F.coalesce("own", F.lit(0)) * 100 <= F.col("n") * (100 - percent)).select(F.col("class").alias("doc_id"))


def _mark(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _entries(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(mark64, sig): the signatures of all sets.

    Of equal sets in a batch one signs for all, so a large group of copies sends few entries.
    """

    def rows(marks: list[int], signed: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"mark64": np.repeat(np.array(marks, np.int64), [len(g) for g in signed]), "sig": np.concatenate(signed)})

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            seen: set[bytes] = set()
            marks, signed, held = [], [], 0
            for t in batch["text"]:
                s = shingle_set(t, hashes, size)
                mark = _mark(s)
                if mark in seen:
                    continue
                seen.add(mark)
                marks.append(_short_mark(mark))
                signed.append(signatures(s, percent).view(np.int64))
                held += len(signed[-1])
                if held > ENTRY_ROWS:
                    yield rows(marks, signed)
                    marks, signed, held = [], [], 0
            if held:
                yield rows(marks, signed)

    return docs.select("text").mapInPandas(sign, "mark64 long, sig long")


def _met(entries: DataFrame) -> DataFrame:
    """Distinct (sig, mark64) of the signatures that several sets have.

    One shuffle; a task then reads its signatures in order and remembers one row, so one with very many sets is streamed, never gathered.
    """

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # signature and mark of the row before, and whether it went out
        for batch in batches:
            sig, mark = batch["sig"].to_numpy(), batch["mark64"].to_numpy()
            if last is not None:
                sig, mark = np.r_[last[0], sig], np.r_[last[1], mark]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (mark[1:] != mark[:-1])]
            sig, mark = sig[new], mark[new]
            if not len(sig):
                continue
            again = sig[1:] == sig[:-1]
            several = np.r_[False, again] | np.r_[again, False]
            told = several.copy()
            if last is not None:
                several[0] |= last[2]
                told[0] &= not last[2]
            last = (sig[-1], mark[-1], bool(several[-1]))
            yield pd.DataFrame({"sig": sig[told], "mark64": mark[told]})

    return entries.repartition("sig").sortWithinPartitions("sig", "mark64").mapInPandas(shared, "sig long, mark64 long")


def _short_mark(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "big", signed=True)


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """Rows whose ``sig`` comes with several values of ``by``.

    Found by an aggregate that combines before it shuffles and a semi-join, so a signature with very many rows meets in no single task.
    """
    several = rows.groupBy("sig").agg(F.min(by).alias("low"), F.max(by).alias("high")).where("low < high").select("sig")
    return rows.join(stored(several, "shared-signatures"), "sig", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: the exact test on the whole texts.

    Classes are hashed into blocks of about ``BLOCK_CHARS``; a task gets the pairs between two blocks, and
    each text that occurs in them once, however many pairs it is in.
    """
    blocks = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    x, y = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in "ab")
    keyed = stored(pairs.select("a", "b", F.least(x, y).alias("i"), F.greatest(x, y).alias("j")), "block-pairs")
    needed = keyed.select("i", "j", F.explode(F.array("a", "b")).alias("class")).distinct().join(texts, "class")

    def test(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        sets = {c: shingle_set(t, hashes, size) for c, t in zip(held["class"], held["text"])}
        found = [linked(sets[a], sets[b], percent) for a, b in zip(rows["a"], rows["b"])]
        return pd.DataFrame({"a": rows["a"], "b": rows["b"], "linked": np.array(found, bool)})

    by_block = keyed.groupBy("i", "j").cogroup(needed.select(F.col("i").alias("p"), F.col("j").alias("q"), "class", "text").groupBy("p", "q"))
    return by_block.applyInPandas(test, "a long, b long, linked boolean")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Alternating large-star and small-star rounds: every round each node passes its neighbours to the
    smallest one it knows. The number of rounds grows with the logarithm of a component's size. Each
    round is written to the shared folder.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
        # Done when every node points straight at its component: no target is itself a source, one target each.
        state = edges.agg(F.count("*"), F.countDistinct("u"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    smallest = edges.groupBy("u").agg(F.min("v").alias("component"))
    nodes = smallest.select(F.col("u").alias("node"), "component")
    return nodes.union(smallest.select(F.col("component").alias("node"), "component").distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest (node, parent) with parent < node, one parent each: the root of each node and of itself.

    Each round every node takes its parent's parent, so rounds grow with the logarithm of the depth.
    """
    at = stored(parents, "forest")
    while True:
        up = at.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = at.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        step = stored(step, "forest")
        moved, at = step.where("moved"), step.select("node", "parent")
        if moved.isEmpty():
            break
    found = at.select("node", F.col("parent").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` after further links (a, b): only the graph between components is searched."""
    ends = _with_component(_with_component(links.select("a", "b"), parts, "a", "u"), parts, "b", "v")
    larger = stored(components(ends.select("u", "v"), "u", "v"), "components")
    nodes = parts.union(larger.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("part"))
    moved = larger.select(F.col("node").alias("part"), F.col("component").alias("_to"))
    return stored(nodes.join(moved, "part", "left").select("node", F.coalesce("_to", "part").alias("component")), "components")


def _with_component(rows: DataFrame, parts: DataFrame, column: str, out: str) -> DataFrame:
    p = parts.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(p, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, screen: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the documents (``doc_id``, ``text``), one row per doc_id.

    Two documents link when 100 x shared shingles >= ``percent`` x all shingles of both. The
    component is the smallest doc_id reachable by links. Documents without words (null, empty,
    blank) have no shingles and link with nothing. Repeated rows are one document; if a doc_id
    comes with several texts, the one with the most shingles (then the larger mark) stands for
    it. Rows without doc_id are left out. Shingles are compared by 64-bit hashes, sets by 128-bit
    marks. Other columns of ``docs`` are not read. ``screen`` changes the cost only: it pays where
    signatures are many (about 0.8 and below) and most texts have no partner.
    """
    docs = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").alias("text")).where("doc_id IS NOT NULL")
    signed = stored(_profiles(docs, size, screened_share(percent) if screen else 0.0), "sets")
    profiles = signed.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "mark")).alias("p"))
    profiles = stored(profiles.select("doc_id", "p.n_shingles", "p.mark"), "profiles")
    classes = stored(profiles.where("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("class"), F.max("n_shingles").alias("n")), "classes")

    signing = docs.join(stored(_screened(signed, classes, percent), "screened"), "doc_id", "left_semi") if screen else docs
    met = stored(_met(_entries(signing, size, percent)), "met")
    # Should two sets have the same short mark, both take its signatures; the texts decide.
    own = classes.select("class", "n", _as_long("mark").alias("mark64"))
    met = stored(met.join(own, "mark64").select("class", "n", "sig"), "met")

    # A bucket with the classes of another one tells nothing new.
    content = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"x{i}") for i in range(2)]
    same = met.groupBy("sig").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), *content).where("size > 1")
    same = same.groupBy("size", "weight", "x0", "x1").agg(F.min("sig").alias("sig"))
    shared = stored(met.join(same.select("sig", "size", "weight"), "sig"), "buckets")

    heads = signed.select(F.col("doc_id").alias("class"), "mark", F.col("n_shingles").alias("n"), "short", "wide")
    heads = heads.join(classes.select("class", "mark"), ["class", "mark"], "left_semi").drop("mark").dropDuplicates(["class"])
    heads = stored(heads.join(shared.select("class").distinct(), "class", "left_semi"), "sketches")
    shared = shared.drop("n")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = stored(ids.join(classes, "class").select(F.col("class").alias("doc_id"), "mark"), "wanted")
        return stored(_texts_of(docs, wanted, profiles, size), "texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        return stored(_verified(pairs, texts_of(ids), size, percent).where("linked").select("a", "b"), "links")

    def mixed(parts: DataFrame) -> DataFrame:
        return _shared(_with_component(shared, parts, "class", "part"), "part")

    # First some neighbours in the largest bucket of each class; then the nearest across components; at last all the rest.
    home = shared.groupBy("class").agg(F.max(F.struct("size", "sig")).alias("h")).select("class", "h.sig")
    home = shared.join(home, ["class", "sig"]).withColumn("part", F.col("class"))
    links = links_of(_nearest_pairs(home.join(heads, "class"), percent, REACH))
    parts = forest_roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    parts = _merged(parts, links_of(_nearest_pairs(mixed(parts).join(heads, "class"), percent)))

    mixed_tiles = _tiled(mixed(parts).join(heads, "class"))
    suspects = stored(_by_bucket(mixed_tiles, lambda rows: _suspects(rows, percent), "sig long, i long, j long, class long"), "suspects")
    # Buckets with the same suspects are one, however many signatures they share.
    groups = suspects.groupBy("sig", "i", "j").agg(F.count("*").alias("size"), *content)
    groups = groups.groupBy("size", "x0", "x1").agg(F.min(F.struct("sig", "i", "j")).alias("g")).select("g.*")
    rest = suspects.join(stored(groups, "suspect-groups"), ["sig", "i", "j"], "left_semi")
    rest = _with_component(rest, parts, "class", "part").join(heads, "class")
    parts = _merged(parts, links_of(_by_bucket(rest, lambda rows: _across(rows, percent), "a long, b long").distinct()))
    labelled = _with_component(classes.select("mark", "class"), parts, "class", "component_id")
    return (
        profiles.join(labelled.select("mark", "component_id"), "mark", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _texts_of(docs: DataFrame, wanted: DataFrame, profiles: DataFrame, size: int) -> DataFrame:
    """(class, text) of the wanted (doc_id, mark), one row each; where doc_ids repeat, the text with that mark."""
    rows, ids = profiles.count(), docs.select(F.count("*")).first()[0]
    if rows == ids:
        found = docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    else:
        found = _with_marks(docs.join(wanted.select("doc_id"), "doc_id", "left_semi"), size).join(wanted, ["doc_id", "mark"], "left_semi")
        found = found.groupBy("doc_id").agg(F.first("text").alias("text"))
    return found.select(F.col("doc_id").alias("class"), "text")


def _as_long(mark: str):
    """The first eight bytes of a mark as a number, as :func:`_short_mark` gives them."""
    return F.conv(F.hex(F.substring(mark, 1, 8)), 16, -10).cast("long")


def _with_marks(docs: DataFrame, size: int) -> DataFrame:
    @F.pandas_udf("binary")
    def mark(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        return pd.Series([_mark(shingle_set(t, hashes, size)) for t in texts], dtype=object)

    return docs.withColumn("mark", mark.asNondeterministic()("text"))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, screen: bool = False) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id names it; all columns stay.

    Rows without doc_id stay as they are; of repeated rows of a kept document one stays.
    """
    own = fresh(docs, "_kept")
    found = near_duplicates(docs, size, percent, screen).where("doc_id = component_id").select(F.col("doc_id").alias(own))
    named = docs.where(quoted("doc_id").isNotNull())
    kept = named.join(found, quoted("doc_id").cast("long") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(quoted("doc_id").isNull()))
