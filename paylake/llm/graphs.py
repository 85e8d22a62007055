"""Proximity graphs over unit vectors in numpy, many queries at a time.

Nearness is the inner product, so for unit vectors the squared distance is 2 - 2 * product. A graph
is an (n x degree) array of neighbours, padded with -1.
"""

from __future__ import annotations

import io

import numpy as np


def beam_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy best-first search with a beam. ``entries`` (queries x e): start nodes of each query.
    Returns (queries x width) nodes, best first (-1: none), and their products."""
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, width), -1, np.int32)
    sims = np.full((nq, width), -np.inf, np.float32)
    done = np.ones((nq, width), bool)

    def offer(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Takes new (row, node) pairs, rows ascending, into the beams."""
        s = np.einsum("ij,ij->i", x[nodes], q[rows])
        live, first, count = np.unique(rows, return_index=True, return_counts=True)
        c = int(count.max())
        more_ids = np.full((len(live), c), -1, np.int32)
        more_sims = np.full((len(live), c), -np.inf, np.float32)
        r, k = np.repeat(np.arange(len(live)), count), np.arange(len(rows)) - np.repeat(first, count)
        more_ids[r, k], more_sims[r, k] = nodes, s
        all_ids = np.concatenate([ids[live], more_ids], 1)
        all_sims = np.concatenate([sims[live], more_sims], 1)
        all_done = np.concatenate([done[live], more_ids < 0], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        sims[live] = np.take_along_axis(all_sims, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)

    def fresh(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = nodes >= 0
        key = np.unique(rows[ok].astype(np.int64) * n + nodes[ok])
        rows, nodes = key // n, key % n
        new = ~seen[rows, nodes]
        rows, nodes = rows[new], nodes[new]
        seen[rows, nodes] = True
        return rows, nodes

    rows, nodes = fresh(np.repeat(np.arange(nq), entries.shape[1]), entries.ravel())
    if len(rows):
        offer(rows, nodes)
    while True:
        wait = ~done
        pick = wait & (np.cumsum(wait, 1) <= expand)
        r, k = np.nonzero(pick)
        if not len(r):
            return ids, sims
        done[r, k] = True
        near = adj[ids[r, k]]
        rows, nodes = fresh(np.repeat(r, near.shape[1]), near.ravel())
        if len(rows):
            offer(rows, nodes)


def prune(x: np.ndarray, nodes: np.ndarray, cands: np.ndarray, degree: int, alpha: float, fill: bool = False) -> np.ndarray:
    """Robust pruning: of each node's candidates (rows, -1: none) keeps the nearest one again and
    again, and drops those to which a kept one is nearer by the factor ``alpha`` than the node. ``fill``:
    places left go to the nearest that were dropped, without which many nodes of a tight group have no
    edge that leads to them."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for a in range(0, len(nodes), 256):
        p, c = nodes[a : a + 256], np.sort(cands[a : a + 256], axis=1)
        v = x[np.maximum(c, 0)]
        d = 2 - 2 * np.einsum("icd,id->ic", v, x[p])
        d[(c < 0) | (c == p[:, None])] = np.inf
        d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        far = d.copy()
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        row, kept = np.arange(len(p)), np.zeros(len(p), np.int64)
        for k in range(degree):
            j = d.argmin(1)
            ok = np.isfinite(d[row, j])
            if not ok.any():
                break
            out[a : a + 256, k][ok] = c[row, j][ok]
            far[row[ok], j[ok]] = np.inf
            kept += ok
            # squared distances: alpha counts twice
            drop = alpha * alpha * between[row, j] <= d
            drop[row, j] = True
            d[drop & ok[:, None]] = np.inf
        if fill and (kept < degree).any():
            order = np.argsort(far, axis=1, kind="stable")[:, :degree]
            more = np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(c, order, 1), -1)
            r, k = np.nonzero(np.arange(degree) >= kept[:, None])
            at = k - kept[r]
            in_ = at < more.shape[1]
            out[a + r[in_], k[in_]] = more[r[in_], at[in_]]
    return out


def build(x: np.ndarray, degree: int, width: int, alpha: float, entries: np.ndarray, seed: int = 1, nodes: np.ndarray | None = None, fill: bool = False) -> np.ndarray:
    """Inserts ``nodes`` (all) in growing batches: a search of the graph so far proposes neighbours,
    pruning keeps diverse ones, and reverse edges are added and pruned. ``entries``: start nodes of
    each node (rows as x)."""
    adj = np.full((len(x), degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(np.arange(len(x)) if nodes is None else nodes)
    at, size = 1, 1
    inside = np.zeros(len(x), bool)
    inside[order[:1]] = True
    while at < len(order):
        p = order[at : at + size]
        start = np.where(inside[entries[p]], entries[p], order[0])
        found, _ = beam_search(x, adj, x[p], start, width)
        # mates of the same batch are candidates too
        if len(p) > 1:
            near = np.argsort(-(x[p] @ x[p].T), axis=1)[:, : min(len(p), 9)]
            found = np.concatenate([found, p[near].astype(np.int32)], 1)
        adj[p] = prune(x, p, found, degree, alpha, fill)
        u = np.repeat(p, degree)
        v = adj[p].ravel()
        u, v = u[v >= 0], v[v >= 0]
        o = np.argsort(v, kind="stable")
        u, v = u[o], v[o]
        target, first, count = np.unique(v, return_index=True, return_counts=True)
        most = min(int(count.max()), 4 * degree)
        k = np.arange(len(v)) - np.repeat(first, count)
        back = np.full((len(target), most), -1, np.int32)
        row = np.repeat(np.arange(len(target)), count)
        back[row[k < most], k[k < most]] = u[k < most]
        both = np.concatenate([adj[target], back], 1)
        free = (both >= 0).sum(1) <= degree
        if free.any():
            b = both[free]
            adj[target[free]] = np.take_along_axis(b, np.argsort(b < 0, axis=1, kind="stable")[:, :degree], 1)
        if not free.all():
            adj[target[~free]] = prune(x, target[~free], both[~free], degree, alpha, fill)
        inside[p] = True
        at += size
        size = max(1, min(2 * size, 512, at // 4))
    return adj


class Vamana:
    """One robust-pruned directed graph, searched from the vector nearest to the mean."""

    DEGREE, WIDTH, ALPHA = 32, 64, 1.2

    def __init__(self, x: np.ndarray, adj: np.ndarray, entry: int):
        self.x, self.adj, self.entry = x, adj, entry

    @classmethod
    def build(cls, x: np.ndarray) -> Vamana:
        entry = int((x @ x.mean(0)).argmax()) if len(x) else 0
        return cls(x, build(x, cls.DEGREE, cls.WIDTH, cls.ALPHA, np.full((len(x), 1), entry)), entry)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.x, self.adj, q, np.full((len(q), 1), self.entry), min(width, len(self.x)))


class HNSW:
    """Hierarchical navigable small world: every layer is a graph over a random subset of the one
    below; a search descends through the upper layers to its start nodes in the lowest.

    A layer has a ``THIN``-th of the nodes of the one below, and ``STARTS`` nodes are handed down: vectors in
    tight groups, all alike far from each other, keep few links between groups, so groups have to be
    entered from above.
    """

    LINKS, WIDTH, THIN, STARTS = 16, 48, 16, 4

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry  # layers: lowest first

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> HNSW:
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(cls.THIN)).astype(int), 12)
        g = cls(x, [], int(level.argmax()) if n else 0)
        for at in range(int(level.max()) if n else 0, -1, -1):
            entries = g._descend(x) if g.layers else np.full((n, 1), g.entry)
            g.layers.insert(0, build(x, cls.LINKS * (2 if at == 0 else 1), cls.WIDTH, 1.0, entries, seed + at, np.flatnonzero(level >= at), True))
        return g

    def _descend(self, q: np.ndarray, upto: int = 0) -> np.ndarray:
        start = np.full((len(q), 1), self.entry)
        for layer in reversed(self.layers[upto:]):
            best, _ = beam_search(self.x, layer, q, start, self.STARTS, 2)
            start = np.where(best >= 0, best, start[:, :1])
        return start

    def search(self, q: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found of each query; ``own``: the nodes that the queries are, to start from too."""
        start = self._descend(q, 1)
        if own is not None:
            start = np.c_[start, own]
        return beam_search(self.x, self.layers[0], q, start, min(width, len(self.x)))

    def within(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, low: float) -> np.ndarray:
        """(queries x nodes): the nodes of at least ``low`` that edges lead to from those of the beams (``ids``, ``sims``)
        over nodes of at least ``low``. The cost follows the number of such nodes."""
        found = np.zeros((len(q), len(self.x)), bool)
        r, k = np.nonzero((sims >= low) & (ids >= 0))
        front = [(r, ids[r, k])]
        found[front[0]] = True
        seen = found.copy()
        while front:
            rows, nodes = front.pop()
            if len(rows) > 1 << 15:
                front.append((rows[1 << 15 :], nodes[1 << 15 :]))
                rows, nodes = rows[: 1 << 15], nodes[: 1 << 15]
            near = self.layers[0][nodes]
            rows = np.repeat(rows, near.shape[1])
            ok = (near.ravel() >= 0) & ~seen[rows, near.ravel()]
            key = np.unique(rows[ok].astype(np.int64) * len(self.x) + near.ravel()[ok])
            rows, nodes = key // len(self.x), key % len(self.x)
            seen[rows, nodes] = True
            link = np.einsum("ij,ij->i", self.x[nodes], q[rows]) >= low
            if link.any():
                front.append((rows[link], nodes[link]))
                found[front[-1]] = True
        return found


def packed(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def unpacked(data) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def labels_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the pairs u, v."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new
