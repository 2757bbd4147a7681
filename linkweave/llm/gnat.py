"""A geometric near-neighbour access tree over few points, searched by whole batches of queries in numpy.

A node holds some split points; every other point belongs to the nearest of them. For each split i and child j the node stores
the range of distances from i to j's points. A query with a best distance r so far skips child j as soon as some split tells
that all of j's points lie strictly farther than r. Points and queries are whole numbers, so squared distances are exact;
roots are rounded outwards, and a child that may hold a point at distance r is never skipped, so ties go to the
lowest index as in a full search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Splits of a node, and points up to which a child is a plain list.
SPLITS, LEAF = 32, 8
#: Whole numbers up to here are exact as floating ones.
EXACT = 2.0**53
_LESS, _MORE = 1 - 2.0**-50, 1 + 2.0**-50


def is_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances of rows of a and b are exact in floating point."""
    reach = 2.0 * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    return a.shape[1] * reach**2 < EXACT


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, whole numbers either way: by inner products if both are floating."""
    if a.dtype.kind == "f":
        return np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


@dataclass
class Node:
    ids: np.ndarray  # ascending
    points: np.ndarray
    low: np.ndarray | None = None  # [split, child]
    high: np.ndarray | None = None
    children: list[Node | None] | None = None


def spread(points: np.ndarray, n: int) -> list[int]:
    """Up to n different points, each the farthest from those before; the first is the first."""
    chosen, far = [0], squares(points, points[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squares(points, points[chosen[-1:]])[:, 0])
    return sorted(chosen)


def built(ids: np.ndarray, points: np.ndarray) -> Node:
    if len(ids) <= LEAF:
        return Node(ids, points)
    at = spread(points, SPLITS)
    if len(at) == 1:  # equal points: the lowest index stands for all
        return Node(ids[:1], points[:1])
    rest = np.setdiff1d(np.arange(len(ids)), at)
    d = squares(points[rest], points[at])
    home, root = d.argmin(1), np.sqrt(d.astype(np.float64))
    low, high = np.full((len(at), len(at)), np.inf), np.full((len(at), len(at)), -np.inf)
    children: list[Node | None] = []
    for j in range(len(at)):
        mine = home == j
        if mine.any():
            low[:, j], high[:, j] = root[mine].min(0) * _LESS, root[mine].max(0) * _MORE
        children.append(built(ids[rest[mine]], points[rest[mine]]) if mine.any() else None)
    return Node(ids[at], points[at], low, high, children)


class Gnat:
    """Nearest of ``points`` (rows of whole numbers) for batches of queries; ``met``: distances computed so far."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.exact = is_exact(points, points)
        self.root = self._tree()
        self.met = 0

    def _tree(self) -> Node:
        return built(np.arange(len(self.points)), self.points.astype(np.float64) if self.exact else self.points)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest point, the lowest index of equally near ones."""
        if self.exact and not is_exact(queries, self.points):
            self.exact = False
            self.root = self._tree()
        q = queries.astype(np.float64) if self.exact else queries
        best = np.full(len(q), -1)
        dist = np.full(len(q), np.inf if self.exact else np.iinfo(np.int64).max, q.dtype)
        self._visit(self.root, q, np.arange(len(q)), best, dist)
        return best, dist.astype(np.int64)

    def _meet(self, node: Node, queries: np.ndarray, who: np.ndarray, best: np.ndarray, dist: np.ndarray) -> np.ndarray:
        d = squares(queries[who], node.points)
        self.met += d.size
        k = d.argmin(1)
        near, index = d[np.arange(len(who)), k], node.ids[k]
        won = (near < dist[who]) | (near == dist[who]) & (index < best[who])
        best[who[won]], dist[who[won]] = index[won], near[won]
        return d

    def _visit(self, node: Node, queries: np.ndarray, who: np.ndarray, best: np.ndarray, dist: np.ndarray) -> None:
        """All splits, then the nearest split's child for a close bound, then the children that the bound leaves."""
        d = self._meet(node, queries, who, best, dist)
        children = [(j, c) for j, c in enumerate(node.children or []) if c is not None]
        home, root = d.argmin(1), np.sqrt(d.astype(np.float64))
        for j, child in children:
            if len(mine := who[home == j]):
                self._visit(child, queries, mine, best, dist)
        for j, child in children:
            reach = np.sqrt(dist[who].astype(np.float64))[:, None] * _MORE
            out = (root * _LESS > (reach + node.high[:, j]) * _MORE) | ((root * _MORE + reach) * _MORE < node.low[:, j])
            if len(left := who[~(out.any(1) | (home == j))]):
                self._visit(child, queries, left, best, dist)
