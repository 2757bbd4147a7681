"""Graphs in packs: whole connected components as compact arrays, one row a pack, worked on by numpy where they lie.

Nothing that a graph algorithm makes of a component concerns another one, so products, searches and flows of a pack need no shuffle:
what goes to disk is the graph itself, once, compressed, and once more for each of the parts that a pack's columns are dealt to. Small
components share a pack. A component of more than ``MOST_ARCS`` arcs (or of more nodes than an algorithm allows) is not packed: its
cells are handed back, and the callers treat them by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkweave.operators.components import connected_components
from linkweave.plans.lineage import cut, dropped, stored

#: Arcs of a pack of small components, and of the largest component that is packed.
PACK_ARCS, MOST_ARCS = 1 << 20, 5_000_000
#: Arcs of a pack for searches from all nodes, whose work grows with the square of a pack's nodes.
SEARCH_ARCS = 1 << 15
#: Cells or words that a kernel holds at a time, and rows of a batch that it hands out.
HELD, BATCH = 1 << 20, 1 << 17
#: Joins of nodes (what partitions leave of their cells) that one task puts together; more are joined in rounds.
ONE_TASK = 4_000_000
#: Nodes up to which their packs are told by broadcast.
BROADCAST_NODES = 2_000_000
SCHEMA = "pack long, nodes long, arcs long, sizes array<long>, data array<binary>"
KINDS = (np.int64, np.int64, np.int32, np.float64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


@dataclass
class Graph:
    """A matrix by columns: ids of its nodes in order; column i has rows[ptr[i]:ptr[i + 1]], in order, as places in ids."""

    ids: np.ndarray
    ptr: np.ndarray
    rows: np.ndarray
    vals: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, cols: np.ndarray, rows: np.ndarray, vals: np.ndarray) -> Graph:
        order = np.lexsort((rows, cols))
        return cls(ids, np.append(0, np.cumsum(np.bincount(cols, minlength=len(ids)))), rows[order], vals[order])

    @property
    def n(self) -> int:
        return len(self.ids)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    @cached_property
    def cols(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.sizes)

    @cached_property
    def back(self) -> Graph:
        """The transpose."""
        return Graph.of(self.ids, self.rows, self.cols, self.vals)

    def sums(self) -> np.ndarray:
        return np.bincount(self.cols, self.vals, self.n)

    def kept(self, keep: np.ndarray) -> Graph:
        return Graph.of(self.ids, self.cols[keep], self.rows[keep], self.vals[keep])

    def without_loops(self) -> Graph:
        return self.kept(self.cols != self.rows)

    def with_loops(self, value: float | None = None) -> Graph:
        """Each column with cells has a loop of this value, or of its largest other one."""
        g = self.without_loops()
        has = np.flatnonzero(self.sizes if value is not None else g.sizes)
        if value is None:
            value = np.maximum.reduceat(g.vals, g.ptr[has]) if len(has) else g.vals
        return Graph.of(g.ids, np.append(g.cols, has), np.append(g.rows, has), np.append(g.vals, np.broadcast_to(value, len(has))))

    def stochastic(self) -> Graph:
        return Graph(self.ids, self.ptr, self.rows, self.vals / self.sums()[self.cols])

    def of_columns(self, cols: np.ndarray) -> np.ndarray:
        """Places of the cells of some columns."""
        return ragged(self.ptr[cols], self.sizes[cols])

    def span(self, part: int, parts: int) -> range:
        """The columns of a part."""
        return range(self.n * part // parts, self.n * (part + 1) // parts)


def written(pack: int, g: Graph) -> pa.Table:
    arrays = [np.ascontiguousarray(x, k) for x, k in zip((g.ids, g.ptr, g.rows, g.vals), KINDS)]
    data = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in arrays]
    row = {"pack": [pack], "nodes": [g.n], "arcs": [len(g.rows)], "sizes": [[x.nbytes for x in arrays]], "data": [data]}
    return pa.table(row, pa.schema([("pack", pa.int64()), ("nodes", pa.int64()), ("arcs", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.list_(pa.binary()))]))


def read(sizes: list[int], data: list[bytes]) -> Graph:
    return Graph(*(np.frombuffer(pa.decompress(x, n, "zstd", asbytes=True) if n else b"", k) for x, n, k in zip(data, sizes, KINDS)))


def builder(mirror: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def build(key: tuple, t: pa.Table) -> pa.Table:
        cols, rows, vals = (np.asarray(t.column(c)) for c in ("col", "row", "val"))
        ids, at = np.unique(np.append(cols, rows), return_inverse=True)
        cols, rows = at[: len(cols)], at[len(cols) :]
        if mirror:
            other = cols != rows
            cols, rows, vals = np.append(cols, rows[other]), np.append(rows, cols[other]), np.append(vals, vals[other])
        return written(key[0].as_py(), Graph.of(ids, cols, rows, vals))

    return build


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (a, b) join it with."""
    home = np.arange(n)
    while True:
        one, two = home[a], home[b]
        apart = one != two
        if not apart.any():
            return home
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(home, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = home[home]
            if (up == home).all():
                break
            home = up


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, n): the nodes of a partition's cells, the smallest node that these join each with, and how many cells it is the column of."""
    ids, root, n = (np.zeros(0, np.int64) for _ in range(3))

    def told(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols, rows = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("col", "row"))
        nodes, at = np.unique(np.concatenate([cols, rows, ids, root]), return_inverse=True)
        cols, rows, old, top = np.split(at, np.cumsum([len(cols), len(rows), len(ids)]))
        home = local_components(np.append(cols, old), np.append(rows, top), len(nodes))
        return nodes, nodes[home], np.bincount(cols, minlength=len(nodes)) + np.bincount(old, n, len(nodes)).astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > HELD:
            (ids, root, n), held = told(held), []
    ids, root, n = told(held) if held else (ids, root, n)
    for i in range(0, len(ids), BATCH):
        yield pa.RecordBatch.from_pydict({"node": ids[i : i + BATCH], "root": root[i : i + BATCH], "n": n[i : i + BATCH]})


@dataclass
class Packs:
    """Packs (pack, nodes, arcs, sizes, data), and the cells of the components too large for them, if there are any."""

    packs: DataFrame
    rest: DataFrame | None


def packed(cells: DataFrame | Packs, mirror: bool = False, most_nodes: int | None = None, pack_arcs: int | None = None) -> Packs:
    """A matrix by components. ``mirror``: the cells are one direction of each arc, and packs and rest get both. Components of more than
    ``most_nodes`` nodes go to the rest too; small components share packs of about ``pack_arcs`` arcs. A cell of either direction connects; repeated cells stay as they are."""
    if isinstance(cells, Packs):
        return cells
    spark, pack_arcs = cells.sparkSession, min(PACK_ARCS, pack_arcs or PACK_ARCS)
    c, folder = stored(cells.select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), F.col("val").cast("double").alias("val")))
    arcs, twice = c.count(), 1 + mirror
    if arcs * twice <= min(pack_arcs, MOST_ARCS) and (most_nodes is None or arcs <= most_nodes // 2 or c.select(F.explode(F.array("col", "row"))).distinct().count() <= most_nodes):
        packs = cut(c.withColumn("pack", F.lit(0).cast("long")).groupBy("pack").applyInArrow(builder(mirror), SCHEMA))
        dropped(spark, folder)
        return Packs(packs, None)
    stars = cut(c.repartitionByRange("col").mapInArrow(contracted, "node long, root long, n long"))
    if stars.count() <= ONE_TASK:
        joined = stars.select(F.col("node").alias("col"), F.col("root").alias("row")).coalesce(1).mapInArrow(contracted, "node long, root long, n long").select("node", F.col("root").alias("component"))
    else:
        joined = connected_components(stars, "node", "root")
    of = stars.groupBy("node").agg(F.sum("n").alias("n")).join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    of = cut(of)
    dropped(spark)
    size = of.groupBy("component").agg((F.sum("n") * twice).alias("arcs"), F.count("*").alias("nodes"))
    large = F.col("arcs") > MOST_ARCS
    large = large if most_nodes is None else large | (F.col("nodes") > most_nodes)
    whole = F.col("arcs") * 4 > pack_arcs
    small = size.agg(F.coalesce(F.sum(F.when(~whole, F.col("arcs"))), F.lit(0))).first()[0]
    bins = F.pmod(F.xxhash64("component"), F.lit(small // pack_arcs + 1))
    # packs by a number of their own: two kinds can't meet in one
    size = cut(size.select("component", F.when(large, None).when(whole, F.col("component") * 2 + 1).otherwise(bins * 2).alias("pack")))
    at = cut(of.filter("n > 0").join(size, "component").select(F.col("node").alias("col"), "pack"))
    dealt = c.join(F.broadcast(at) if at.count() <= BROADCAST_NODES else at, "col").select("col", "row", "val", "pack")
    packs = cut(dealt.filter("pack is not null").groupBy("pack").applyInArrow(builder(mirror), SCHEMA))
    if size.filter("pack is null").isEmpty():
        dropped(spark, folder)
        return Packs(packs, None)
    rest = dealt.filter("pack is null").select("col", "row", "val")
    back = rest.filter("col <> row").select(F.col("row").alias("col"), F.col("col").alias("row"), "val")
    return Packs(packs, cut(rest.unionByName(back) if mirror else rest))


def run(packs: DataFrame, kernel: Callable[[Graph, int, int], Iterator[dict]], schema: str, split: bool = True, more: str = "") -> DataFrame:
    """The batches that ``kernel(graph, part, parts)`` gives for each pack, a dict of columns each; ``split``: packs are dealt to several parts
    where there are fewer of them than cores. ``more`` names further columns of packs, which the kernel gets behind."""
    n = packs.count()
    parts = max(1, -(-2 * packs.sparkSession.sparkContext.defaultParallelism // max(n, 1))) if split else 1
    names, extra = [x.split()[0] for x in schema.split(",")], more.split()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                g = read(row.column("sizes")[0].as_py(), row.column("data")[0].as_py())
                for made in kernel(g, row.column("part")[0].as_py(), parts, *(row.column(x)[0].as_py() for x in extra)):
                    yield pa.RecordBatch.from_pydict({k: made[k] for k in names}, schema=kinds)

    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[x.split()[1]]) for x in schema.split(",")])
    dealt = packs.select("pack", "sizes", "data", *extra, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return dealt.repartitionByRange(max(1, min(n * parts, 10_000)), "pack", "part").mapInArrow(of, schema)


def batches(n: int, **columns: np.ndarray) -> Iterator[dict]:
    for i in range(0, n, BATCH):
        yield {k: x[i : i + BATCH] for k, x in columns.items()}


def products(a: Graph, b: Graph, cols: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, rows, values) of the product a b, some whole columns at a time, in order. Cells that add up to zero are left out."""
    n, step = a.n, max(1, HELD // max(a.n, 1))
    for low in range(cols.start, cols.stop, step):
        own = np.arange(low, min(low + step, cols.stop))
        at = b.of_columns(own)
        k, mine = b.rows[at], np.repeat(np.arange(len(own)), b.sizes[own])
        cell = a.of_columns(k)
        m = a.sizes[k]
        dense = np.bincount(a.rows[cell] + np.repeat(mine * n, m), a.vals[cell] * np.repeat(b.vals[at], m), len(own) * n)
        found = np.flatnonzero(dense)
        yield low + found // n, found % n, dense[found]


def column_sums(cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """For each cell the sum of its column; columns come together."""
    low = cols[0] if len(cols) else 0
    return np.bincount(cols - low, vals)[cols - low]


def cells_out(g: Graph, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], name: str = "val") -> Iterator[dict]:
    for cols, rows, vals in found:
        yield from batches(len(cols), col=g.ids[cols], row=g.ids[rows], **{name: vals})


CELL = "col long, row long, val double"


def by_packs(p: Packs, kernel: Callable, other: Callable[[DataFrame], DataFrame], schema: str = CELL, **options) -> DataFrame:
    """What ``kernel`` makes of packs, and ``other`` of the cells of larger components."""
    made = run(p.packs, kernel, schema, **options)
    return made if p.rest is None else made.unionByName(other(p.rest))
