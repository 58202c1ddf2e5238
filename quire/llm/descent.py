"""NN-descent and greedy search over the rows of one matrix, as plain arrays.

A graph is a matrix of packed edges: 31 bits of distance (one less the cosine), then the neighbour's row, then a bit
that is set while the edge is *fresh*, that is, not yet joined with others.  So a row's edges sort by plain numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW, WORD, ONE = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(1)
#: Nodes of a leaf of the first graph; neighbours, fresh and joined ones, each way, that meet at a node; share of
#: edges that may be fresh at the end; centers joined at once and pairs gathered before they are merged.
LEAF, JOINED, SETTLED, CENTERS, PAIRS = 256, 20, 0.03, 1024, 1_500_000
#: Nodes that a search visits in a round, its entries, the nodes that these are chosen from, queries at once.
VISITS, ENTRIES, ENTRANCES, QUERIES = 8, 8, 1024, 128


def _packed(sims: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Fresh edges."""
    far = np.clip((1 - sims.astype(np.float64)) * (1 << 29), 0, (1 << 31) - 1).astype(np.uint64)
    return far << WORD | rows.astype(np.uint64) << ONE | ONE


def rows_of(graph: np.ndarray) -> np.ndarray:
    return ((graph & LOW) >> ONE).astype(np.int64)


def sims_of(graph: np.ndarray) -> np.ndarray:
    return (1 - (graph >> WORD).astype(np.float64) / (1 << 29)).astype(np.float32)


def _kept(graph: np.ndarray, more: np.ndarray, degree: int) -> np.ndarray:
    """The best ``degree`` edges of each row, an edge once, as it was before if it was there."""
    out = np.empty((len(graph), degree), np.uint64)
    for at in range(0, len(graph), 8192):
        keys = np.concatenate([graph[at : at + 8192], more[at : at + 8192]], axis=1)
        keys = keys << WORD | keys >> WORD
        keys.sort(axis=1)
        ids = keys >> np.uint64(33)
        keys[:, 1:][ids[:, 1:] == ids[:, :-1]] = NONE
        keys = keys << WORD | keys >> WORD
        keys.sort(axis=1)
        out[at : at + 8192] = keys[:, :degree]
    return out


def leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows halved by planes between two random ones, neighbouring leaves one after the other."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        a, b = x[rows[rng.integers(len(rows))]], x[rows[rng.integers(len(rows))]]
        side = x[rows] @ (a - b if (a != b).any() else rng.normal(size=x.shape[1]).astype(np.float32))
        half = np.argpartition(side, len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]


def _grown(x: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The graph and the best of each row in a leaf of one more tree."""
    degree, more = graph.shape[1], np.full_like(graph, NONE)
    for rows in leaves(x, rng):
        sims = x[rows] @ x[rows].T
        np.fill_diagonal(sims, -np.inf)
        n = min(degree, len(rows) - 1)
        if n:
            top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            more[rows, :n] = _packed(np.take_along_axis(sims, top, axis=1), rows[top])
    return _kept(graph, more, degree)


def _firsts(keys: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` of each group of sorted keys, a group being what stands above ``shift`` bits: which, group, place."""
    group = (keys >> np.uint64(shift)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    which = np.flatnonzero(place < n)
    return which, group[which], place[which]


def _meeting(graph: np.ndarray, chosen: np.ndarray, joined: int) -> np.ndarray:
    """For each row the rows that meet there: its ``chosen`` neighbours, and the best ``joined`` that chose it; the
    number of rows stands for none."""
    n = len(graph)
    u, at = np.nonzero(chosen)
    v, far = rows_of(graph[u, at]), (graph[u, at] >> WORD) >> np.uint64(7)
    bits = n.bit_length()
    out = np.full((n, 2 * joined), n, np.int32)
    place = (np.cumsum(chosen, axis=1) - 1)[u, at]
    out[u, place] = v
    back = v.astype(np.uint64) << np.uint64(bits + 24) | far << np.uint64(bits) | u.astype(np.uint64)
    back.sort()
    which, center, place = _firsts(back, bits + 24, joined)
    out[center, joined + place] = (back[which] & np.uint64((1 << bits) - 1)).astype(np.int32)
    out.sort(axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = n
    out.sort(axis=1)
    return out


def _merged(graph: np.ndarray, found: list[np.ndarray], bits: int, fine: int) -> np.ndarray:
    keys = np.concatenate(found)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    which, u, place = _firsts(keys, bits + fine, graph.shape[1])
    more = np.full((len(graph), int(place.max()) + 1), NONE)
    far = (keys[which] >> np.uint64(bits)) & np.uint64((1 << fine) - 1)
    more[u, place] = far << np.uint64(31 - fine + 32) | (keys[which] & np.uint64((1 << bits) - 1)) << ONE | ONE
    return _kept(graph, more, graph.shape[1])


def descend(x: np.ndarray, degree: int, trees: int, rounds: int | None, rng: np.random.Generator) -> np.ndarray:
    """The graph of unit rows: ``trees`` trees, then ``rounds`` rounds or, if None, until it settles."""
    n = len(x)
    graph = np.full((n, max(0, min(degree, n - 1))), NONE)
    if n < 2:
        return graph
    for _ in range(trees if n > LEAF else 1):
        graph = _grown(x, graph, rng)
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    bits = n.bit_length()
    fine = min(31, 64 - 2 * bits)
    done = 0
    while rounds is None or done < rounds:
        there, fresh = graph != NONE, (graph & ONE) == ONE
        fresh &= there
        new, old = fresh & (np.cumsum(fresh, axis=1) <= JOINED), there & ~fresh
        old &= np.cumsum(old, axis=1) <= JOINED
        news, olds = _meeting(graph, new, JOINED), _meeting(graph, old, JOINED)
        graph[new] &= ~ONE
        worst, found, size = _worst(graph), [], 0
        for at in range(0, n, CENTERS):
            a, b = news[at : at + CENTERS], olds[at : at + CENTERS]
            a, b = a[:, : max(1, int((a < n).sum(axis=1).max()))], b[:, : int((b < n).sum(axis=1).max())]
            both = np.concatenate([a, b], axis=1)
            sims = padded[a] @ padded[both].transpose(0, 2, 1)
            for better, turned in ((sims > worst[a][:, :, None], False), (sims > worst[both][:, None, :], True)):
                if turned:
                    better[:, :, : a.shape[1]] = False  # stands there the other way round too
                at_all = np.flatnonzero(better)
                c, j = np.divmod(at_all, both.shape[1])
                u, v = a.reshape(-1)[c].astype(np.uint64), both[c // a.shape[1], j].astype(np.uint64)
                ok = (u != v) & (u < n) & (v < n)
                far = np.clip((1 - sims.reshape(-1)[at_all[ok]].astype(np.float64)) * (1 << 29), 0, (1 << 31) - 1).astype(np.uint64) >> np.uint64(31 - fine)
                u, v = (v[ok], u[ok]) if turned else (u[ok], v[ok])
                found.append(u << np.uint64(bits + fine) | far << np.uint64(bits) | v)
                size += len(u)
            if size > PAIRS:
                graph = _merged(graph, found, bits, fine)
                worst, found, size = _worst(graph), [], 0
        if size:
            graph = _merged(graph, found, bits, fine)
        done += 1
        if np.count_nonzero((graph & ONE == ONE) & (graph != NONE)) <= SETTLED * graph.size:
            break
    return graph


def _worst(graph: np.ndarray) -> np.ndarray:
    """The cosine that an edge must beat; nothing beats what stands for no row."""
    last = graph[:, -1]
    return np.append(np.where(last == NONE, np.float32(-2), sims_of(last)), np.float32(3)).astype(np.float32)


def links(graph: np.ndarray, n: int) -> np.ndarray:
    """Each row's best ``n`` neighbours and the best ``n`` rows that it is a neighbour of; the number of rows stands for none."""
    there = graph != NONE
    return _meeting(graph, there & (np.cumsum(there, axis=1) <= n), n)


def greedy(x: np.ndarray, near: np.ndarray, asked: np.ndarray, beam: int) -> np.ndarray:
    """For each asked vector the ``beam`` rows of ``x`` of largest inner product that were seen, best first, or the
    number of rows where there are fewer."""
    n = len(x)
    if n <= max(beam, 64):
        return np.argsort(-(asked @ x.T), axis=1, kind="stable")
    return np.concatenate([_greedy(x, near, asked[at : at + QUERIES], beam) for at in range(0, len(asked), QUERIES)])


def _ordered(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers that sort by falling score; above the bit for a visited row stands the row."""
    bits = scores.astype("<f4").view(np.int32)
    return -(bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32 | rows.astype(np.int64) << 1


def _greedy(x: np.ndarray, near: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    n, m, none = len(x), len(q), np.iinfo(np.int64).max
    entrances = np.arange(0, n, max(1, n // ENTRANCES))
    sims = q @ x[entrances].T
    first = np.argpartition(-sims, ENTRIES - 1, axis=1)[:, :ENTRIES]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    np.put_along_axis(seen, entrances[first], True, axis=1)
    kept = np.full((m, beam), none)
    kept[:, :ENTRIES] = np.sort(_ordered(np.take_along_axis(sims, first, axis=1), entrances[first]), axis=1)
    going = np.arange(m)
    while len(going):
        own = kept[going]
        unseen = (own & 1) == 0  # what stands for none is odd
        unseen &= np.cumsum(unseen, axis=1) <= VISITS
        r, c = np.nonzero(unseen)
        to = near[(own[r, c] & 0xFFFFFFFF) >> 1]
        own[r, c] |= 1
        who = np.repeat(r * np.int64(n + 1), to.shape[1])
        key = (who + to.reshape(-1))[~seen[going[r][:, None], to].reshape(-1)]
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]  # a row can be a neighbour of two visited ones
        who, to = np.divmod(key, n + 1)
        seen[going[who], to] = True
        key = _ordered(np.einsum("ij,ij->i", q[going[who]], x[to]), to)
        better = np.flatnonzero(key < own[who, -1])
        who, key = who[better], key[better]
        counts = np.bincount(who, minlength=len(going))
        place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        more = np.full((len(going), int(counts.max())), none)
        more[who, place] = key
        both = np.concatenate([own, more], axis=1)
        both.sort(axis=1)
        kept[going] = both[:, :beam]
        going = going[((both[:, :beam] & 1) == 0).any(axis=1)]
    return np.where(kept == none, n, (kept & 0xFFFFFFFF) >> 1)
