"""A directed neighbour graph with robust pruning, in numpy, for one shard of bounded size.

Nearness is the largest inner product. Vectors get one more coordinate that gives all of them the
norm of the longest; then Euclidean order from any query is inner-product order, and the pruning
rule, which needs a distance, holds.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 64
ALPHA = 1.2
BATCH = 512
EXPAND = 4
STARTS = 48
RANDOM = 24


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors of equal norm whose first coordinates are the given ones, scaled to a longest norm of 1."""
    norm = (vectors.astype(np.float64) ** 2).sum(1)
    top = norm.max()
    rest = np.sqrt(np.maximum(top - norm, 0))
    return (np.column_stack([vectors, rest]) / np.sqrt(top)).astype(np.float32)


def beam_search(
    points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: (ids, distances), nearest first, -1 where fewer were met.

    Each step expands the nearest unexpanded entries of every beam until none is left.
    """
    n, q, beam = len(points), len(queries), max(beam, len(starts))
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    first = starts
    d = ((queries[:, None] - points[first][None]) ** 2).sum(2)
    order = np.argsort(d, 1, kind="stable")
    ids[:, : len(first)] = first[order]
    dist[:, : len(first)] = np.take_along_axis(d, order, 1)
    open_[:, : len(first)] = True
    seen[:, first] = True
    active = rows
    while len(active):
        rank = np.where(open_[active], dist[active], np.inf)
        width = min(EXPAND, beam)
        pick = np.argpartition(rank, width - 1, 1)[:, :width] if width < beam else np.argsort(rank, 1)
        good = np.isfinite(np.take_along_axis(rank, pick, 1))
        r, c = np.nonzero(good)
        who = active[r]
        col = pick[r, c]
        open_[who, col] = False
        near = graph[ids[who, col]]
        owner = np.repeat(r, near.shape[1])
        flat = near.ravel()
        ok = flat >= 0
        owner, flat = owner[ok], flat[ok]
        fresh = ~seen[active[owner], flat]
        key = np.unique(owner[fresh] * n + flat[fresh])
        owner, flat = key // n, key % n
        if len(key):
            at = active[owner]
            seen[at, flat] = True
            gap = points[flat] - queries[at]  # not 1 - cosine, which cannot tell near copies apart
            nd = np.einsum("ij,ij->i", gap, gap)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[begin, len(owner)])
            place = np.arange(len(owner)) - np.repeat(begin, count)
            wide = count.max()
            who = active[owner[begin]]
            line = np.repeat(np.arange(len(begin)), count)
            new_d = np.full((len(begin), wide), np.inf, np.float32)
            new_i = np.full((len(begin), wide), -1, np.int64)
            new_d[line, place], new_i[line, place] = nd, flat
            all_d = np.concatenate([dist[who], new_d], 1)
            all_i = np.concatenate([ids[who], new_i], 1)
            all_o = np.concatenate([open_[who], np.isfinite(new_d)], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :beam]
            dist[who] = np.take_along_axis(all_d, order, 1)
            ids[who] = np.take_along_axis(all_i, order, 1)
            open_[who] = np.take_along_axis(all_o, order, 1)
        active = active[open_[active].any(1)]
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """At most ``degree`` diverse neighbours per node from its candidates (-1 pads).

    The nearest candidate stays and removes all that are, by the factor ``alpha``, nearer to it than
    to the node; then the next.
    """
    cand = candidates.copy()
    cand[cand == nodes[:, None]] = -1
    c = points[np.maximum(cand, 0)] - points[nodes][:, None]  # seen from the node, so near copies keep their distances
    d = np.einsum("ikj,ikj->ik", c, c)
    d[cand < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    c = np.take_along_axis(c, order[:, :, None], 1)
    length = np.einsum("ikj,ikj->ik", c, c)
    between = length[:, :, None] + length[:, None] - 2 * (c @ c.transpose(0, 2, 1))
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    rows = np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1, np.int64)
    squared = np.float32(alpha * alpha)  # distances are squared here
    for i in range(degree):
        best = alive.argmax(1)
        live = alive[rows, best]
        if not live.any():
            break
        out[live, i] = cand[rows, best][live]
        near = between[rows, best]
        alive &= ~((squared * near <= d) | (near <= 0)) | ~live[:, None]
        alive[rows, best] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starts): neighbours per point, and the points searches start from.

    Searches start from a random sample of points. Points enter in batches of growing size: a greedy search on the graph so far proposes
    neighbours, pruning keeps diverse ones, and the edges are added backwards as well. Points that
    no path from the start reaches become further starts, so every point can be found.
    """
    n, rng = len(points), np.random.default_rng(len(points))
    graph = np.full((n, degree), -1, np.int64)
    order = rng.permutation(n)
    done, starts = 1, order[:STARTS]
    while done < n:
        batch = order[done : done + max(1, min(BATCH, done))]
        found, _ = beam_search(points, graph, starts[:done], points[batch], beam)
        # Members of a batch do not see each other in the graph yet.
        mates = np.argsort(-(points[batch] @ points[batch].T), 1, kind="stable")[:, : degree // 2 + 1]
        # A few random points: inside a crowd of near copies nothing else would lead out of it.
        far = order[rng.integers(0, done, (len(batch), RANDOM))]
        graph[batch] = robust_prune(points, batch, np.concatenate([found, batch[mates], far], 1), degree, alpha)
        _add_back(points, graph, batch, degree, alpha)
        done += len(batch)
    return graph, _all_reachable(points, graph, starts)


def _add_back(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(batch, degree)
    target = graph[batch].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    gap = points[source] - points[target]
    gap = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((gap, target))
    source, target = source[order], target[order]
    begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    count = np.diff(np.r_[begin, len(target)])
    nodes, place = target[begin], np.arange(len(target)) - np.repeat(begin, count)
    width = min(int(count.max(initial=0)), 2 * degree)  # nearest first: of a hub's many proposals the pruning keeps near ones anyway
    incoming = np.full((len(nodes), width), -1, np.int64)
    inside = place < width
    incoming[np.repeat(np.arange(len(nodes)), count)[inside], place[inside]] = source[inside]
    have = (graph[nodes] >= 0).sum(1) + (incoming >= 0).sum(1)
    merged = np.concatenate([graph[nodes], incoming], 1)
    easy = have <= degree
    if easy.any():
        m = merged[easy]
        m = np.take_along_axis(m, np.argsort(m < 0, 1, kind="stable"), 1)[:, :degree]
        graph[nodes[easy]] = m
    for lo in range(0, len(nodes), 4 * BATCH):
        part = np.flatnonzero(~easy[lo : lo + 4 * BATCH]) + lo
        if len(part):
            graph[nodes[part]] = robust_prune(points, nodes[part], merged[part], degree, alpha)


def _all_reachable(points: np.ndarray, graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    reached = np.zeros(len(points), bool)
    starts = list(starts)
    front = np.array(starts)
    while True:
        while len(front):
            reached[front] = True
            near = np.unique(graph[front])
            near = near[near >= 0]
            front = near[~reached[near]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return np.array(starts)
        starts.append(int(left[0]))
        front = left[:1]
