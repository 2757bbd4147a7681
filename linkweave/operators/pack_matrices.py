"""Products, similarities and distances of a matrix's columns by packs; cells come as a table or in packs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from linkweave.operators import markov as K, packs as P, transforms as T

Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def squared(cells: DataFrame | P.Packs) -> DataFrame:
    """The matrix times itself."""
    return P.by_packs(P.packed(cells), lambda g, part, parts: P.cells_out(g, P.products(g, g, g.span(part, parts))), lambda c: T.product(c, c))


def expanded_inflated(cells: DataFrame | P.Packs, inflation: float) -> DataFrame:
    """Loops of the column maximum, columns scaled to 1, the square, its values to the power ``inflation`` and columns scaled again."""

    def kernel(g: P.Graph, part: int, parts: int):
        g = g.with_loops().stochastic()

        def found() -> Found:
            for cols, rows, vals in P.products(g, g, g.span(part, parts)):
                vals = vals**inflation
                yield cols, rows, vals / P.column_sums(cols, vals)

        return P.cells_out(g, found())

    return P.by_packs(P.packed(cells), kernel, lambda c: T.Cells(T.max_loops(c)).stochastic().expand().inflate(inflation).df)


def regularised_step(cells: DataFrame | P.Packs, inflation: float) -> DataFrame:
    """``markov.regularised_step`` of a graph's own flow, with loops of 1."""

    def kernel(g: P.Graph, part: int, parts: int):
        g = g.with_loops(1.0).stochastic()

        def found() -> Found:
            for cols, rows, vals in P.products(g, g, g.span(part, parts)):
                vals = vals**inflation
                vals = vals / P.column_sums(cols, vals)
                own, at, n = np.unique(cols, return_index=True, return_counts=True)
                mean, top = np.add.reduceat(vals, at) / n, np.maximum.reduceat(vals, at)
                bar = np.minimum(top, np.maximum(1e-7, 0.9 * mean * (1 - 2 * (top - mean))))
                keep = vals >= np.repeat(bar, n) - 1e-12
                cols, rows, vals = cols[keep], rows[keep], vals[keep]
                yield cols, rows, vals / P.column_sums(cols, vals)

        return P.cells_out(g, found())

    def other(c: DataFrame) -> DataFrame:
        g = T.stochastic(K.with_unit_loops(c, c.select(F.col("col").alias("node")).distinct()))
        return K.regularised_step(g, g, inflation)

    return P.by_packs(P.packed(cells), kernel, other)


def co_citation(cells: DataFrame | P.Packs, least: float) -> DataFrame:
    """``transforms.co_citation``."""

    def kernel(g: P.Graph, part: int, parts: int):
        found = ((cols, rows, vals) for cols, rows, vals in P.products(g.back, g, g.span(part, parts)))
        keep = ((c[k], r[k], v[k]) for c, r, v in found for k in [(c != r) & (v >= least)])
        return P.cells_out(g, keep)

    return P.by_packs(P.packed(cells), kernel, lambda c: T.co_citation(c, least))


def gathered(found: Found) -> Found:
    """Columns together, up to a batch of cells."""
    held, n = [], 0
    for x in found:
        held, n = [*held, x], n + len(x[0])
        if n >= P.BATCH:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def inverse_log_similarity(cells: DataFrame | P.Packs) -> DataFrame:
    """``transforms.inverse_log_similarity``."""

    def kernel(g: P.Graph, part: int, parts: int):
        g = g.without_loops()
        # a node's lists of those that have it as a row, by the root of their weight
        hop = g.back
        with np.errstate(divide="ignore"):
            w = np.where(g.sizes > 1, np.log(2.0) / np.log(g.sizes), 0.0)
        by = P.Graph(g.ids, hop.ptr, hop.rows, np.ones(len(hop.rows)))
        weighted = P.Graph(g.ids, hop.ptr, hop.rows, w[hop.rows])
        found = ((c, r, v) for c, r, v in gathered(shared(by, weighted, g, part, parts)))
        return P.cells_out(g, ((c[k], r[k], v[k]) for c, r, v in found for k in [v > 0]))

    return P.by_packs(P.packed(cells), kernel, T.inverse_log_similarity)


def shared(a: P.Graph, b: P.Graph, arcs: P.Graph, part: int, parts: int) -> Found:
    """For the arcs (column, row) of a part the inner product of the column of ``a`` and the row's column of ``b``."""
    x = np.zeros(a.n)
    for c in arcs.span(part, parts):
        near = arcs.rows[arcs.ptr[c] : arcs.ptr[c + 1]]
        if not len(near):
            continue
        mine = slice(a.ptr[c], a.ptr[c + 1])
        x[a.rows[mine]] = a.vals[mine]
        at = b.of_columns(near)
        yield np.full(len(near), c), near, np.bincount(np.repeat(np.arange(len(near)), b.sizes[near]), x[b.rows[at]] * b.vals[at], len(near))
        x[a.rows[mine]] = 0


def flow_distance(cells: DataFrame | P.Packs) -> DataFrame:
    """``transforms.flow_distance`` of a matrix's stochastic columns over its own arcs: (col, row, distance)."""

    def kernel(g: P.Graph, part: int, parts: int):
        f = g.stochastic()
        norm = np.bincount(f.cols, f.vals * f.vals, f.n)
        found = gathered(shared(f, f, f, part, parts))
        return P.cells_out(f, ((c, r, np.sqrt(np.maximum(norm[c] + norm[r] - 2 * v, 0))) for c, r, v in found), "distance")

    return P.by_packs(P.packed(cells), kernel, lambda c: T.flow_distance(T.stochastic(c), c), "col long, row long, distance double")


def squared_twice(cells: DataFrame | P.Packs) -> DataFrame:
    """The fourth power of a matrix, a column at a time: no power is kept whole. Values are added in another order than by squaring the square."""

    def kernel(g: P.Graph, part: int, parts: int):
        def found() -> Found:
            for own in g.span(part, parts):
                x = np.zeros(g.n)
                x[g.rows[g.ptr[own] : g.ptr[own + 1]]] = g.vals[g.ptr[own] : g.ptr[own + 1]]
                for _ in range(3):
                    some = np.flatnonzero(x)
                    at = g.of_columns(some) if 2 * len(some) < g.n else slice(None)
                    cols = np.repeat(some, g.sizes[some]) if 2 * len(some) < g.n else g.cols
                    x = np.bincount(g.rows[at], g.vals[at] * x[cols], g.n)
                rows = np.flatnonzero(x)
                yield np.full(len(rows), own), rows, x[rows]

        return P.cells_out(g, gathered(found()))

    return P.by_packs(P.packed(cells), kernel, lambda c: T.step(c, 2))
