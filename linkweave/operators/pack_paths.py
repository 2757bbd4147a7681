"""Distances, centralities, directed layers and hubs of whole components in memory; sources of a component are dealt to several tasks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from linkweave.operators import packs as P

#: Sources of a search that go together, one bit each.
SOURCES = 512


def waves(g: P.Graph, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(steps, bits): from sources first to last, all at once, which nodes (rows) each source (a bit) comes to for the first time. A source comes
    to itself only on a cycle."""
    words = -(-(last - first) // 64)
    own = np.arange(first, last)
    seen = np.zeros((g.n, words), np.uint64)
    front = np.zeros((g.n, words), np.uint64)
    front[own, (own - first) // 64] = np.uint64(1) << ((own - first) % 64).astype(np.uint64)
    has = np.flatnonzero(g.back.sizes)
    span = max(1, P.HELD // words)
    for steps in itertools.count(1):
        new = np.zeros((g.n, words), np.uint64)
        low = 0
        while low < len(has):  # so many nodes at a time that their arcs' words stay within bounds
            high = max(low + 1, int(np.searchsorted(g.back.ptr[has + 1], g.back.ptr[has[low]] + span, "right")))
            some = has[low:high]
            arcs = slice(g.back.ptr[some[0]], g.back.ptr[some[-1] + 1])
            new[some] = np.bitwise_or.reduceat(front[g.back.rows[arcs]], g.back.ptr[some] - g.back.ptr[some[0]])
            low = high
        front = new & ~seen
        if not front.any():
            return
        seen |= front
        yield steps, front


def bits(words: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n bits is set, by rows."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def searches(g: P.Graph, part: int, parts: int) -> Iterator[range]:
    own = g.span(part, parts)
    for low in range(own.start, own.stop, SOURCES):
        yield range(low, min(low + SOURCES, own.stop))


def distances(g: P.Graph, part: int, parts: int):
    """(source, node, dist) of all nodes as sources."""
    g = g.without_loops()
    for own in searches(g, part, parts):
        ids = g.ids[own.start : own.stop]
        yield {"source": ids, "node": ids, "dist": np.zeros(len(ids), np.int64)}
        for steps, front in waves(g, own.start, own.stop):
            for low in range(0, g.n, max(1, P.HELD // SOURCES)):
                rows, s = np.nonzero(bits(front[low : low + max(1, P.HELD // SOURCES)], len(ids)))
                rows += low
                other = rows != s + own.start
                yield from P.batches(int(other.sum()), source=ids[s[other]], node=g.ids[rows[other]], dist=np.full(int(other.sum()), steps))


def eccentricity(g: P.Graph, part: int, parts: int):
    """(node, ecc) of all nodes, as ``paths.eccentricity``."""
    g = g.without_loops()
    for own in searches(g, part, parts):
        far = np.zeros(len(own), np.int64)
        mine = np.arange(own.start, own.stop), np.arange(len(own))
        for steps, front in waves(g, *(own.start, own.stop)):
            # the way round to a source itself is no distance
            front[mine[0], mine[1] // 64] &= ~(np.uint64(1) << (mine[1] % 64).astype(np.uint64))
            far[bits(np.bitwise_or.reduce(front, axis=0)[None], len(own))[0]] = steps
        yield {"node": g.ids[own.start : own.stop], "ecc": far}


def betweenness(g: P.Graph, part: int, parts: int):
    """(node, score): what the sources of a part add to each node. Waves go from the nodes reached or, where fewer arcs lead there, from those that
    aren't; only arcs of shortest paths are kept for the way back."""
    g = g.without_loops()
    total = np.zeros(g.n)
    for s in g.span(part, parts):
        dist, paths = np.full(g.n, -1, np.int32), np.zeros(g.n)
        dist[s], paths[s] = 0, 1.0
        front, arcs, left = np.array([s]), [], g.sizes.sum() - g.back.sizes[s]
        for d in itertools.count(1):
            if g.sizes[front].sum() <= left:
                at = g.of_columns(front)
                child, parent = g.rows[at], np.repeat(front, g.sizes[front])
                new = dist[child] < 0
            else:
                open_ = np.flatnonzero(dist < 0)
                at = g.back.of_columns(open_)
                child, parent = np.repeat(open_, g.back.sizes[open_]), g.back.rows[at]
                new = dist[parent] == d - 1
            child, parent = child[new], parent[new]
            if not len(child):
                break
            paths += np.bincount(child, paths[parent], g.n)
            dist[child] = d
            front = np.flatnonzero(dist == d)
            left -= g.back.sizes[front].sum()
            arcs.append((child, parent))
        dep = np.zeros(g.n)
        for child, parent in reversed(arcs):
            dep += np.bincount(parent, paths[parent] / paths[child] * (1 + dep[child]), g.n)
        dep[s] = 0.0
        total += dep
    yield {"node": g.ids, "score": total}


def ceil_neighbours(k: int):
    """The kernel of ``transforms.ceil_neighbours``: hub by hub."""

    def kernel(g: P.Graph, part: int, parts: int):
        key = g.cols * g.n + g.rows
        reverse = g.rows.astype(np.int64) * g.n + g.cols
        at = np.minimum(np.searchsorted(key, reverse), max(len(key) - 1, 0))
        at[key[at] != reverse] = -1
        alive = np.ones(len(key), bool)
        hubs = np.flatnonzero(g.sizes > k)
        for c in hubs[np.argsort(-g.sizes[hubs], kind="stable")]:
            own = np.arange(g.ptr[c], g.ptr[c + 1])
            own = own[alive[own]]
            if len(own) > k:
                gone = own[np.lexsort((g.rows[own], -g.vals[own]))[k:]]
                alive[gone] = False
                back = at[gone]
                alive[back[back >= 0]] = False
        yield from P.batches(int(alive.sum()), col=g.ids[g.cols[alive]], row=g.ids[g.rows[alive]], val=g.vals[alive])

    return kernel


def ranked(damping: float, size: int, loose: list[float], rounds: int | None, enough: float, most_rounds: int, told: bool):
    """The kernel of ``paths.page_rank`` for components in which every node has arcs: its ranks after ``rounds`` rounds, or (``told``) the change of
    each round until that is under ``enough`` a node. ``loose``: the rank of nodes without arcs before each round."""

    def kernel(g: P.Graph, part: int, parts: int):
        out, rank, changes = g.stochastic(), np.full(g.n, 1.0 / size), []
        for i in range(most_rounds if rounds is None else rounds):
            got = np.bincount(out.rows, out.vals * rank[out.cols], g.n)
            new = (1 - damping) / size + damping * (got + loose[i] / size)
            changes.append(float(np.abs(new - rank).sum()))
            rank = new
            if told and changes[-1] < enough * g.n:
                break  # its share of what may change in all
        if told:
            yield {"round": np.arange(1, len(changes) + 1), "change": changes}
        else:
            yield {"node": g.ids, "rank": rank}

    return kernel


def up_and_down(g: P.Graph, part: int, parts: int):
    """(node, up, down, loop, size): arcs go from column to row: the layers of nodes that a node leads to, and of those that lead to it, whether it
    is on a cycle (1), and the nodes of its weak component."""
    home = P.local_components(g.cols, g.rows.astype(np.int64), g.n)
    size = np.bincount(home, minlength=g.n)[home]
    for own in searches(g, part, parts):
        made = []
        for way in (g, g.back):
            far, loop = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            at = np.arange(len(own))
            for steps, front in waves(way, own.start, own.stop):
                far[bits(np.bitwise_or.reduce(front, axis=0)[None], len(own))[0]] = steps
                loop |= (front[at + own.start, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            made.append((far, loop))
        yield {"node": g.ids[own.start : own.stop], "up": made[0][0], "down": made[1][0], "loop": made[0][1], "size": size[own.start : own.stop]}


def layers_of(g: P.Graph) -> list[np.ndarray]:
    """Nodes by the most arcs of a path from them: none first; an error for a graph with cycles."""
    left, out = g.sizes.copy(), []
    now = np.flatnonzero(left == 0)
    while len(now):
        out.append(now)
        told = g.back.rows[g.back.of_columns(now)]
        left -= np.bincount(told, minlength=g.n)
        now = np.unique(told[left[told] == 0])
    if sum(map(len, out)) < g.n:
        raise ValueError("the graph has cycles")
    return out


def reduced(g: P.Graph, part: int, parts: int):
    """(x, y): the arcs (column to row) of an acyclic graph that no longer way replaces. What each node reaches is kept as bits, for some targets
    at a time."""
    layers, kept = layers_of(g), np.ones(len(g.rows), bool)
    words = max(1, P.HELD * 8 // max(g.n, 1))
    own = g.span(part, parts)
    targets = np.unique(g.rows)
    targets = targets[(targets >= own.start) & (targets < own.stop)]
    for low in range(0, len(targets), words * 64):
        some = targets[low : low + words * 64]
        at = np.full(g.n, -1)
        at[some] = np.arange(len(some))
        wide = -(-len(some) // 64)
        far = np.zeros((g.n, wide), np.uint64)  # reached over two arcs and more
        one = np.zeros((g.n, wide), np.uint64)
        mine = np.flatnonzero(at[g.rows] >= 0)
        np.bitwise_or.at(one, (g.cols[mine], at[g.rows[mine]] // 64), np.uint64(1) << (at[g.rows[mine]] % 64).astype(np.uint64))
        for layer in layers[1:]:
            for some_of in np.array_split(layer, max(1, g.sizes[layer].sum() * wide // P.HELD)):
                if len(some_of):
                    parents = g.rows[g.of_columns(some_of)]
                    far[some_of] = np.bitwise_or.reduceat(far[parents] | one[parents], np.cumsum(g.sizes[some_of]) - g.sizes[some_of])
        kept[mine] &= (far[g.cols[mine], at[g.rows[mine]] // 64] >> (at[g.rows[mine]] % 64).astype(np.uint64) & np.uint64(1)) == 0
    mine = np.flatnonzero(kept & (g.rows >= own.start) & (g.rows < own.stop))
    yield from P.batches(len(mine), x=g.ids[g.cols[mine]], y=g.ids[g.rows[mine]])
