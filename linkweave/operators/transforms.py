"""Transforms of sparse matrices given as cell(col, row, val); a missing cell is zero.

Zero values are dropped by everything that makes values. Ties in top-k selections are broken by the smaller row, except
where a threshold keeps them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.plans.lineage import cut


def mirrored(edges: DataFrame) -> DataFrame:
    """Both arcs of each undirected edge (u, v, weight); a loop gives one."""
    e = edges.select(F.col("u").alias("col"), F.col("v").alias("row"), F.col("weight").alias("val"))
    return e.unionByName(transpose(e.filter("col <> row")))


def keep(cells: DataFrame, gq: float | None = None, gt: float | None = None, lq: float | None = None, lt: float | None = None) -> DataFrame:
    v = F.col("val")
    tests = [t for x, t in ((gq, lambda x: v >= x), (gt, lambda x: v > x), (lq, lambda x: v <= x), (lt, lambda x: v < x)) if x is not None for t in [t(x)]]
    for t in tests:
        cells = cells.filter(t)
    return cells


def mapped(cells: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Every value through a column function; zeros go."""
    return cells.select("col", "row", f(F.col("val")).cast("double").alias("val")).filter("val <> 0")


def log(base: float = 0) -> Callable[[Column], Column]:
    """Logarithm to a base (0: natural)."""
    return (lambda v: F.ln(v) / F.ln(F.lit(float(base)))) if base else (lambda v: F.ln(v))


def clamp_high(most: float) -> Callable[[Column], Column]:
    """``ceil(x)``: values over x become x."""
    return lambda v: F.least(v, F.lit(float(most)))


def clamp_low(least: float) -> Callable[[Column], Column]:
    """``floor(x)``: values under x become x."""
    return lambda v: F.greatest(v, F.lit(float(least)))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("row").alias("col"), F.col("col").alias("row"), "val")


def with_reverse(cells: DataFrame, how: str = "left") -> DataFrame:
    """Adds ``back``: the value of the reverse arc, 0 where there is none."""
    back = cells.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("val").alias("back"))
    return cells.join(back, ["col", "row"], how).select("col", "row", F.coalesce("val", F.lit(0.0)).alias("val"), F.coalesce("back", F.lit(0.0)).alias("back"))


def symmetrised(cells: DataFrame, how: str) -> DataFrame:
    """max, min, add or mul of the matrix with its transpose; a missing arc counts as zero.

    max and add need no join: the union with the transpose is aggregated. A loop meets itself.
    """
    both = cells.unionByName(transpose(cells))
    if how == "max":
        return both.groupBy("col", "row").agg(F.max("val").alias("val")).filter("val <> 0")
    if how == "add":
        return both.groupBy("col", "row").agg(F.sum("val").alias("val")).filter("val <> 0")
    f = {"min": F.least("val", "back"), "mul": F.col("val") * F.col("back")}[how]
    return with_reverse(cells, "inner").select("col", "row", f.alias("val")).filter("val <> 0")


def arc_max(cells: DataFrame) -> DataFrame:
    """The larger arc of each pair (both, if equal)."""
    return with_reverse(cells).filter("val >= back").select("col", "row", "val")


def arc_bound(cells: DataFrame, which: str, test: str, x: float) -> DataFrame:
    """Arcs whose pair meets a bound: ``max``: either direction does, ``min``: both do, ``diff``: their distance does.

    ``diff`` with an upper bound is meant as |w - w'| within the bound.
    """
    op = {"gq": ">=", "gt": ">", "lq": "<=", "lt": "<"}[test]
    cond = {"max": f"(val {op} {x} or back {op} {x})", "min": f"(val {op} {x} and back {op} {x})", "diff": f"abs(val - back) {op} {x}"}[which]
    return with_reverse(cells).filter(cond).select("col", "row", "val")


def arc_subtract(cells: DataFrame) -> DataFrame:
    """A minus its transpose, over the arcs of both."""
    neg = transpose(cells).withColumn("val", -F.col("val"))
    return cells.unionByName(neg).groupBy("col", "row").agg(F.sum("val").alias("val")).filter("val <> 0")


def without_loops(cells: DataFrame) -> DataFrame:
    return cells.filter("col <> row")


def max_loops(cells: DataFrame) -> DataFrame:
    """Each column's loop set to its largest other value."""
    rest = without_loops(cells)
    return rest.unionByName(rest.groupBy("col").agg(F.max("val").alias("val")).select("col", F.col("col").alias("row"), "val"))


def norm_self(cells: DataFrame) -> DataFrame:
    """Each column divided by its loop, or by its maximum where it has none."""
    d = cells.groupBy("col").agg(F.coalesce(F.max(F.when(F.col("col") == F.col("row"), F.col("val"))), F.max("val")).alias("d"))
    return cells.join(d, "col").select("col", "row", (F.col("val") / F.nullif("d", F.lit(0.0))).alias("val"))


def ranked(cells: DataFrame, name: str = "rank") -> DataFrame:
    """Adds each cell's place in its column by value, descending, then row."""
    return cells.withColumn(name, F.row_number().over(W.partitionBy("col").orderBy(F.desc("val"), "row")))


def top_k(cells: DataFrame, k: int) -> DataFrame:
    return ranked(cells).filter(F.col("rank") <= k).select("col", "row", "val")


def top_k_ties(cells: DataFrame, k: int) -> DataFrame:
    """Cells of a column not below its k-th value: all ties at the last place stay."""
    return cells.withColumn("r", F.rank().over(W.partitionBy("col").orderBy(F.desc("val")))).filter(F.col("r") <= k).select("col", "row", "val")


def mutual_knn(cells: DataFrame, k: int) -> DataFrame:
    """Arcs in the top k of both ends: each column is cut to its k best, and an arc stays if its reverse does too."""
    best = top_k(cells, k)
    return best.join(best.select(F.col("row").alias("col"), F.col("col").alias("row")), ["col", "row"], "left_semi").select("col", "row", "val")


def either_knn(cells: DataFrame, k: int) -> DataFrame:
    """Arcs in the top k of either end, symmetrised by the maximum."""
    return symmetrised(top_k(cells, k), "max")


def ceil_neighbours(cells, k: int, max_rounds: int = 100) -> DataFrame:
    """Columns with more than k arcs keep their k strongest, hubs first; removed arcs take their reverse along. ``cells`` may come in packs.

    The order is by degree descending, then node. A component is gone through hub by hub in one task, a larger one in rounds."""
    from linkweave.operators import pack_paths, packs as P

    return P.by_packs(P.packed(cells), pack_paths.ceil_neighbours(k), lambda c: ceil_in_rounds(c, k, max_rounds), split=False)


def ceil_in_rounds(cells: DataFrame, k: int, max_rounds: int = 100) -> DataFrame:
    """``ceil_neighbours`` of components too large for packs.

    The order is by degree descending, then node. Each round handles all hubs that no adjacent hub precedes; their removals can't
    touch one another's ranking, so the rounds give the same graph as hub by hub.
    """
    degree = cells.groupBy("col").agg(F.count("*").alias("d"))
    done = None
    for _ in range(max_rounds):
        now = cells.groupBy("col").agg(F.count("*").alias("now"))
        hubs = now.filter(F.col("now") > k).join(degree, "col").select("col", "d")
        if done is not None:
            hubs = hubs.join(done, "col", "left_anti")
        hubs = cut(hubs)
        if hubs.isEmpty():
            return cells
        other = hubs.select(F.col("col").alias("row"), F.col("d").alias("d2"))
        beaten = cells.join(hubs, "col").join(other, "row").filter("d2 > d or (d2 = d and row < col)").select("col").distinct()
        turn = cut(hubs.join(beaten, "col", "left_anti").select("col"))
        gone = ranked(cells.join(turn, "col", "left_semi")).filter(F.col("rank") > k).select("col", "row")
        gone = cut(gone.unionByName(gone.select(F.col("row").alias("col"), F.col("col").alias("row"))).distinct())
        cells = cut(cells.join(gone, ["col", "row"], "left_anti"))
        done = turn if done is None else cut(done.unionByName(turn))
    raise RuntimeError("hubs did not settle")


def shared_neighbours(cells: DataFrame, weight: Column) -> DataFrame:
    """For each arc the sum of ``weight`` (over ``deg`` of a neighbour common to both ends, itself of degree over 1)."""
    deg = cells.groupBy("col").agg(F.count("*").alias("deg")).filter("deg > 1")
    hop = cells.join(deg, "col").select("col", "row", weight.alias("w"))  # via node ``col``
    two = hop.select("col", F.col("row").alias("a"), "w").join(hop.select("col", F.col("row").alias("b")), "col").filter("a <> b")
    pairs = cells.select(F.col("col").alias("a"), F.col("row").alias("b"))
    return two.join(pairs, ["a", "b"], "left_semi").groupBy(F.col("a").alias("col"), F.col("b").alias("row")).agg(F.sum("w").alias("val"))


def inverse_log_similarity(cells: DataFrame) -> DataFrame:
    """Sum over common neighbours of degree over 1 of ln 2 / ln degree, for connected pairs."""
    return shared_neighbours(without_loops(cells), F.ln(F.lit(2.0)) / F.ln("deg"))


def ssq_filter(cells: DataFrame, x: float) -> DataFrame:
    """Cells over x times their column's (sum of squares - loop squared) / (sum - loop)."""
    loop = F.coalesce(F.sum(F.when(F.col("col") == F.col("row"), F.col("val"))), F.lit(0.0))
    s = cells.groupBy("col").agg(((F.sum(F.col("val") * F.col("val")) - loop * loop) / F.nullif(F.sum("val") - loop, F.lit(0.0))).alias("bar"))
    return cells.join(s, "col").filter(F.col("val") > x * F.col("bar")).select("col", "row", "val")


def quantile_filter(cells: DataFrame, q: float) -> DataFrame:
    """The best floor(q * degree + 1/2) cells of each column."""
    n = cells.groupBy("col").agg(F.count("*").alias("n"))
    return ranked(cells).join(n, "col").filter(F.col("rank") <= F.floor(q * F.col("n") + 0.5)).select("col", "row", "val")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product a b: column c of the product is the sum over k of b[c, k] times column k of a."""
    left = b.select("col", F.col("row").alias("k"), F.col("val").alias("x"))
    right = a.select(F.col("col").alias("k"), "row", F.col("val").alias("y"))
    return left.join(right, "k").groupBy("col", "row").agg(F.sum(F.col("x") * F.col("y")).alias("val")).filter("val <> 0")


def step(cells: DataFrame, k: int) -> DataFrame:
    """The matrix squared k times, by blocked products."""
    from linkweave.operators import blocks

    cells = cut(cells)
    for _ in range(k):
        cells = cut(blocks.product(cells, cells))
    return cells


def stochastic(cells: DataFrame) -> DataFrame:
    """Columns scaled to sum 1."""
    s = cells.groupBy("col").agg(F.sum("val").alias("s"))
    return cells.join(s, "col").select("col", "row", (F.col("val") / F.nullif("s", F.lit(0.0))).alias("val"))


def inflated(cells: DataFrame, r: float) -> DataFrame:
    """Values to the power r, columns scaled to sum 1."""
    return stochastic(mapped(cells, lambda v: F.pow(v, F.lit(float(r)))))


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Cell-wise add, minus, max or mul (Hadamard) over the support of both."""
    if how == "mul":
        return a.join(b.withColumnRenamed("val", "other"), ["col", "row"]).select("col", "row", (F.col("val") * F.col("other")).alias("val")).filter("val <> 0")
    if how == "max":  # against zero where a side is missing
        sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
        return sides.groupBy("col", "row").agg(F.when(F.count("*") == 2, F.max("val")).otherwise(F.greatest(F.max("val"), F.lit(0.0))).alias("val")).filter("val <> 0")
    b = b.withColumn("val", -F.col("val")) if how == "minus" else b
    return a.unionByName(b).groupBy("col", "row").agg(F.sum("val").alias("val")).filter("val <> 0")


def identity(nodes: DataFrame, value: float = 1.0) -> DataFrame:
    return nodes.select(F.col("node").alias("col"), F.col("node").alias("row"), F.lit(value).alias("val"))


def folded(cells: DataFrame, masters: DataFrame) -> DataFrame:
    """Nodes replaced by their masters (node, master; others stand for themselves), merged by the maximum, without loops."""
    m = masters.select(F.col("node").alias("col"), F.col("master").alias("mc"))
    n = masters.select(F.col("node").alias("row"), F.col("master").alias("mr"))
    out = cells.join(m, "col", "left").join(n, "row", "left").select(F.coalesce("mc", "col").alias("col"), F.coalesce("mr", "row").alias("row"), "val")
    return out.filter("col <> row").groupBy("col", "row").agg(F.max("val").alias("val"))


def renamed(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both indices through a mapping (old, new); cells with an unmapped index go, cells that fall together add up."""
    c = mapping.select(F.col("old").alias("col"), F.col("new").alias("nc"))
    r = mapping.select(F.col("old").alias("row"), F.col("new").alias("nr"))
    return cells.join(c, "col").join(r, "row").groupBy(F.col("nc").alias("col"), F.col("nr").alias("row")).agg(F.sum("val").alias("val"))


def ncut_weights(cells: DataFrame, how: str = "product") -> DataFrame:
    """Weights divided by degrees: ``one``: the column's, ``product``: both ends', ``sqrt``: the root of both."""
    d = cells.groupBy("col").agg(F.sum("val").alias("d"))
    out = cells.join(d, "col").join(d.select(F.col("col").alias("row"), F.col("d").alias("d2")), "row")
    by = {"one": F.col("d"), "product": F.col("d") * F.col("d2"), "sqrt": F.sqrt(F.col("d") * F.col("d2"))}[how]
    return out.select("col", "row", (F.col("val") / F.nullif(by, F.lit(0.0))).alias("val"))


def threshold_pruned(cells: DataFrame, least: float = 1e-7) -> DataFrame:
    """Cells of a column not under 0.9 * mean * (1 - 2 (max - mean)), a bar held between ``least`` and the maximum.

    Cells at the bar stay, whichever way it is rounded.
    """
    s = cells.groupBy("col").agg(F.avg("val").alias("a"), F.max("val").alias("m"))
    bar = F.least(F.col("m"), F.greatest(F.lit(least), 0.9 * F.col("a") * (1 - 2 * (F.col("m") - F.col("a")))))
    return cells.join(s, "col").filter(F.col("val") >= bar - 1e-12).select("col", "row", "val")


def co_citation(cells: DataFrame, least: float) -> DataFrame:
    """A times its transpose without the diagonal, cells of at least ``least``; one triangle is computed and mirrored."""
    a = cells.select(F.col("row").alias("k"), F.col("col").alias("a"), F.col("val").alias("x"))
    b = cells.select(F.col("row").alias("k"), F.col("col").alias("b"), F.col("val").alias("y"))
    half = a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("weight")).filter(F.col("weight") >= least)
    return mirrored(half.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight"))


def frobenius(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the root of the summed squared differences."""
    return combined(a, b, "minus").agg(F.coalesce(F.sqrt(F.sum(F.col("val") * F.col("val"))), F.lit(0.0)).alias("distance"))


def flow_distance(flows: DataFrame, arcs: DataFrame) -> DataFrame:
    """For each arc the Euclidean distance of its ends' flow columns, from norms and one inner product."""
    norm = flows.groupBy("col").agg(F.sum(F.col("val") * F.col("val")).alias("n"))
    f = flows.select(F.col("col").alias("a"), F.col("row").alias("k"), F.col("val").alias("x"))
    g = flows.select(F.col("col").alias("b"), F.col("row").alias("k"), F.col("val").alias("y"))
    e = arcs.select(F.col("col").alias("a"), F.col("row").alias("b"))
    dot = e.join(f, "a").join(g, ["b", "k"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    out = e.join(dot, ["a", "b"], "left").join(norm.select(F.col("col").alias("a"), F.col("n").alias("na")), "a", "left").join(norm.select(F.col("col").alias("b"), F.col("n").alias("nb")), "b", "left")
    square = F.coalesce("na", F.lit(0.0)) + F.coalesce("nb", F.lit(0.0)) - 2 * F.coalesce("dot", F.lit(0.0))
    return out.select(F.col("a").alias("col"), F.col("b").alias("row"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def perturbed(cells: DataFrame, radius: float) -> DataFrame:
    """Values scaled by 1 + radius * cosine of the ends' columns: breaks ties the same way on every run."""
    norm = cells.groupBy("col").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("n"))
    f = cells.select(F.col("col").alias("a"), F.col("row").alias("k"), F.col("val").alias("x"))
    g = cells.select(F.col("col").alias("b"), F.col("row").alias("k"), F.col("val").alias("y"))
    e = cells.select(F.col("col").alias("a"), F.col("row").alias("b"), "val")
    dot = e.select("a", "b").join(f, "a").join(g, ["b", "k"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    out = e.join(dot, ["a", "b"], "left").join(norm.select(F.col("col").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("col").alias("b"), F.col("n").alias("nb")), "b")
    return out.select(F.col("a").alias("col"), F.col("b").alias("row"), (F.col("val") * (1 + radius * F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb")))).alias("val"))


class Cells:
    """A matrix with its transforms as methods, to be chained: ``Cells(df).gq(2).mutual_knn(5).stochastic().df``."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _to(self, df: DataFrame) -> Cells:
        return Cells(df)

    def gq(self, x: float) -> Cells:
        return self._to(keep(self.df, gq=x))

    def gt(self, x: float) -> Cells:
        return self._to(keep(self.df, gt=x))

    def lq(self, x: float) -> Cells:
        return self._to(keep(self.df, lq=x))

    def lt(self, x: float) -> Cells:
        return self._to(keep(self.df, lt=x))

    def map(self, f: Callable[[Column], Column]) -> Cells:
        return self._to(mapped(self.df, f))

    def mul(self, x: float) -> Cells:
        return self.map(lambda v: v * x)

    def add(self, x: float) -> Cells:
        return self.map(lambda v: v + x)

    def pow(self, x: float) -> Cells:
        return self.map(lambda v: F.pow(v, F.lit(float(x))))

    def log(self, base: float = 0) -> Cells:
        return self.map(log(base))

    def ceil(self, x: float) -> Cells:
        return self.map(clamp_high(x))

    def floor(self, x: float) -> Cells:
        return self.map(clamp_low(x))

    def tp(self) -> Cells:
        return self._to(transpose(self.df))

    def sym(self, how: str) -> Cells:
        return self._to(symmetrised(self.df, how))

    def mutual_knn(self, k: int) -> Cells:
        return self._to(mutual_knn(self.df, k))

    def either_knn(self, k: int) -> Cells:
        return self._to(either_knn(self.df, k))

    def stochastic(self) -> Cells:
        return self._to(stochastic(self.df))

    def inflate(self, r: float) -> Cells:
        return self._to(inflated(self.df, r))

    def expand(self, other: Cells | None = None) -> Cells:
        return self._to(product(self.df, (other or self).df))

    def add_matrix(self, other: Cells) -> Cells:
        return self._to(combined(self.df, other.df, "add"))

    def hadamard(self, other: Cells) -> Cells:
        return self._to(combined(self.df, other.df, "mul"))
