"""Bin packing of one group of pieces: a swap-based local search, and best-fit-decreasing with a segment tree.

The search starts from pieces as they come and empties bins; best-fit-decreasing is what it is measured by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

SIZES = 8
PASSES = 2
#: Shortest pieces of a bin that pairs are formed of.
WIDTH = 6


class FreeSpace:
    """Segment tree over free capacities: which number of open bins has exactly, or at least, that much room.

    Leaf c holds the bins with c free; an inner node says whether any leaf below is filled, so the
    tightest bin with at least a given room is one walk up and down.
    """

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of the tightest bin with room for ``need``, removed from the tree."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:  # a right child: nothing above it starts further right
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        number = self.bins[free].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return free, number


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> np.ndarray:
    """Bin of each piece; longest first, each into the tightest open bin that takes it."""
    lengths = np.asarray(lengths)
    bin_of, tree, opened = np.zeros(len(lengths), np.int64), FreeSpace(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        spot = tree.take(n)
        if spot is None:
            spot, opened = (capacity, opened), opened + 1
        bin_of[i] = spot[1]
        if spot[0] > n:
            tree.add(spot[0] - n, spot[1])
    return bin_of


def next_fit(lengths: Sequence[int], capacity: int, order: Sequence[int]) -> np.ndarray:
    """Bin of each piece; in ``order``, each into the last bin or a new one."""
    n, bin_of = np.asarray(lengths).tolist(), np.zeros(len(lengths), np.int64)
    number, fill = -1, capacity
    for i in order:
        if fill + n[i] > capacity:
            number, fill = number + 1, 0
        bin_of[i] = number
        fill += n[i]
    return bin_of


def pack(lengths: Sequence[int], capacity: int, seed: int = 1, done: Counter | None = None) -> np.ndarray:
    """Bin of each piece: the local search from next fit in shuffled order, or best-fit-decreasing where that takes fewer bins."""
    n = np.asarray(lengths)
    searched = improve(n, next_fit(n, capacity, np.random.default_rng(seed).permutation(len(n)).tolist()), capacity, done=done)
    fitted = best_fit_decreasing(n, capacity)
    return fitted if len(np.unique(fitted)) < len(np.unique(searched)) else searched


class _Bins:
    """Bins with their pieces, and an index of what underfull bins can take in.

    A bin takes a piece into its room, or in exchange for one or two of its pieces into what they and the room
    make up. ``offers[s]`` holds (size of what leaves, bin, pieces that leave) for places of size s; ``mask`` has the bit of
    every size with an offer, so the next one from a size on is a bit operation.
    """

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray, capacity: int):
        self.n, self.bin_of, self.capacity = lengths.tolist(), bin_of.tolist(), capacity
        self.items: dict[int, list[int]] = {}
        for i, b in enumerate(self.bin_of):
            self.items.setdefault(b, []).append(i)
        self.free = {b: capacity - sum(self.n[i] for i in v) for b, v in self.items.items()}
        self.offers: list[set[tuple[int, int, tuple[int, ...]]]] = [set() for _ in range(capacity + 1)]
        self.mask = 0
        for b, free in self.free.items():
            if free:
                self.show(b)

    def _offers_of(self, b: int) -> list[tuple[int, int, tuple[int, ...]]]:
        n, mine = self.n, sorted(self.items[b], key=lambda i: (self.n[i], i))
        few = mine[:WIDTH]
        singles = [(n[i], b, (i,)) for i in mine]
        return [(0, b, ()), *singles, *((n[i] + n[j], b, (i, j)) for k, i in enumerate(few) for j in few[k + 1 :])]

    def show(self, b: int) -> None:
        """Offer what an underfull bin can take in."""
        if (free := self.free[b]) and self.items[b]:
            for offer in self._offers_of(b):
                self.offers[offer[0] + free].add(offer)
                self.mask |= 1 << (offer[0] + free)

    def hide(self, b: int) -> None:
        if (free := self.free[b]) and self.items[b]:
            for offer in self._offers_of(b):
                at = offer[0] + free
                self.offers[at].discard(offer)
                if not self.offers[at]:
                    self.mask &= ~(1 << at)

    def place(self, size: int, sizes: int) -> tuple[int, int, tuple[int, ...]] | None:
        """(size that leaves, bin, pieces) of the offer that gains most among the ``sizes`` tightest places for ``size``."""
        above, best = self.mask >> size, None
        while above and sizes:
            step = (above & -above).bit_length() - 1
            offer = min(self.offers[size + step])
            if offer[0] < size and (best is None or offer[0] < best[0]):
                best = offer
            above ^= 1 << step
            sizes -= 1
        return best

    def move(self, i: int, to: int) -> None:
        b, n = self.bin_of[i], self.n[i]
        self.items[b].remove(i)
        self.items[to].append(i)
        self.free[b] += n
        self.free[to] -= n
        self.bin_of[i] = to


def improve(lengths: Sequence[int], bin_of: np.ndarray, capacity: int, sizes: int = SIZES, passes: int = PASSES, done: Counter | None = None) -> np.ndarray:
    """Move and exchange pieces between underfull bins while the sum of squared fills grows.

    Bins take their turn as victims, the emptiest first. A victim's pieces go into other bins by moves, by
    one-for-one exchange (a longer piece of the victim for a shorter one elsewhere fills that bin further) and by
    two-for-one exchange (one longer piece of the victim for two shorter ones, and two of the victim
    for a shorter one elsewhere). Each step makes the sum of squares grow; a victim that runs empty is
    gone. The search ends at the fewest bins the tokens allow, after a pass that emptied none, or after
    ``passes``. Of the places a piece may take, the ``sizes`` tightest are looked at. ``done`` counts
    the steps by kind.
    """
    lengths = np.asarray(lengths)
    done = Counter() if done is None else done
    least, opened = -(-int(lengths.sum()) // capacity), len(np.unique(bin_of))  # fewer bins than the tokens need there cannot be
    bins = _Bins(lengths, np.asarray(bin_of), capacity)
    for _ in range(passes):
        before = opened
        for victim in sorted((b for b, free in bins.free.items() if free and bins.items[b]), key=lambda b: (-bins.free[b], b)):
            if opened <= least:
                break
            if not bins.items[victim]:
                continue
            bins.hide(victim)
            _empty(bins, victim, sizes, done)
            bins.show(victim)
            if not bins.items[victim]:
                opened -= 1
                done["emptied"] += 1
        if opened in (before, least):
            break
    _, compact = np.unique(bins.bin_of, return_inverse=True)
    return compact.astype(np.int64)


def _empty(bins: _Bins, victim: int, sizes: int, done: Counter) -> None:
    """Take steps until the victim is empty or none helps."""
    n = bins.n
    while mine := sorted(bins.items[victim], key=lambda i: (-n[i], i)):
        best, given = (0, None), ()
        few = mine[:WIDTH]
        for choice in (*((i,) for i in mine), *((i, j) for k, i in enumerate(few) for j in few[k + 1 :])):
            size = sum(n[i] for i in choice)
            if size > bins.capacity or (offer := bins.place(size, sizes)) is None or len(choice) > 1 and not offer[2]:
                continue
            b = offer[1]
            if (gain := size - offer[0]) > max(best[0], bins.free[b] - bins.free[victim]) and len(offer[2]) * len(choice) <= 2:
                best, given = (gain, offer), choice
                if not offer[2]:
                    break  # moves first, the longest piece first
        if not given:
            return
        _, b, taken = best[1]
        bins.hide(b)
        for i in given:
            bins.move(i, b)
        for i in taken:
            bins.move(i, victim)
        bins.show(b)
        done[f"{len(given)} for {len(taken)}" if taken else "move"] += 1
