"""Spanning forests of heaviest edges, and what follows from them: components at every threshold, and walks in order.

The forest grows by rounds in which every component takes its best edge to another one, so components at least halve. Edges are put in
one order (heavier first, then by their ends), so the forest is the same however it is found. At any threshold the components of
the graph are those of the forest's edges that reach it, so a sweep over thresholds joins each of n - 1 edges once, and components of
components rather than nodes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from linkweave.operators.components import connected_components
from linkweave.operators.stars import numbered
from linkweave.plans.lineage import cut


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, weight), u < v: the forest of heaviest edges of (u, v, weight); ties by smaller u, then v. Loops don't count."""
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight").filter("u < v").groupBy("u", "v").agg(F.max("weight").alias("weight"))
    e = cut(e.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "weight"))
    forest = None
    while not e.isEmpty():
        rank = F.struct("weight", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "weight"))
        best = cut(both.groupBy("a").agg(F.max_by(F.struct("b", "u", "v", "weight"), rank).alias("x")).select("a", "x.*"))
        taken = best.select("u", "v", "weight").distinct()
        forest = cut(taken if forest is None else forest.unionByName(taken))
        root = cut(connected_components(best, "a", "b").withColumnRenamed("component", "c"))
        e = e.join(root.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(root.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter("ca <> cb")
        pair = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max_by(F.struct("u", "v", "weight"), rank).alias("x"))
        e = cut(pair.select("a", "b", "x.*"))
    return edges.select("u", "v", "weight").limit(0) if forest is None else forest


def threshold_sweep(edges: DataFrame, nodes: DataFrame, thresholds: list[float], small: int = 3) -> DataFrame:
    """A row a threshold, of the graph of the edges that weigh as much: ``cutoff``; ``edges``; percentages of nodes in the ``largest``
    component, in components of at most ``small`` nodes (``minor``), in neither (``rest``) and alone (``single``); the expected size of a
    node's component (``cce``); mean, median and quartile distance of weights (``ew_*``, null without edges) and of degrees (``nd_*``)."""
    edges, nodes = cut(edges.select("u", "v", "weight").filter("u <> v")), cut(nodes.select("node").distinct())
    n = nodes.count()
    size, forest, before, found = cut(nodes.select(F.col("node").alias("c"), F.lit(1).cast("long").alias("size"))), spanning_forest(edges), None, []
    for t in sorted(set(thresholds), reverse=True):
        now = forest.filter((F.col("weight") >= t) & (F.lit(True) if before is None else F.col("weight") < before))
        size, forest = merged(size, forest, now)
        s = F.col("size")
        found.append((float(t), *size.agg(F.max("size"), F.sum(F.when(s <= small, s).otherwise(0)), F.sum(F.when(s == 1, s).otherwise(0)), F.sum(s * s)).first()))
        before = t
    w, out = F.col("weight"), []
    spread = lambda x, what: [F.avg(x).alias(f"{what}_mean"), F.percentile(x, F.lit(0.5)).alias(f"{what}_med"), (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias(f"{what}_iqr")]
    each = {i: F.when(w >= t, w.cast("double")) for i, (t, *_) in enumerate(found)}
    weights = edges.agg(*[F.struct(F.count(x).alias("edges"), *spread(x, "ew")).alias(f"t{i}") for i, x in each.items()])
    ends = edges.select(F.col("u").alias("node"), "weight").unionByName(edges.select(F.col("v").alias("node"), "weight"))
    degrees = nodes.join(ends, "node", "left").groupBy("node").agg(*[F.count(x).alias(f"d{i}") for i, x in each.items()])
    degrees = degrees.agg(*[F.struct(*spread(F.col(f"d{i}"), "nd")).alias(f"t{i}") for i in each])
    weights, degrees = weights.first(), degrees.first()
    for i, (t, largest, minor, single, squares) in enumerate(found):
        if n:
            part = [100 * x / n for x in (largest, minor, single)]
            out.append((t, weights[f"t{i}"]["edges"], part[0], part[1], 100 - part[0] - part[1], part[2], squares / n, *list(weights[f"t{i}"])[1:], *degrees[f"t{i}"]))
    schema = "cutoff double, edges long, largest double, minor double, rest double, single double, cce double, ew_mean double, ew_med double, ew_iqr double, nd_mean double, nd_med double, nd_iqr double"
    return edges.sparkSession.createDataFrame(out, schema)


def merged(size: DataFrame, forest: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component sizes (c, size) after the edges ``now`` (u, v) between components, and the forest with its ends renamed to match."""
    root = cut(connected_components(now))
    if root.isEmpty():
        return size, forest
    size = size.join(root.select(F.col("node").alias("c"), "component"), "c", "left").groupBy(F.coalesce("component", "c").alias("c")).agg(F.sum("size").alias("size"))
    a, b = (root.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    out = forest.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "weight")
    return cut(size), cut(out.filter("u <> v"))


def tour(arcs: DataFrame) -> DataFrame:
    """The arcs (x, y, first) of trees in the order in which a walk takes them: ``left``, the arcs from here on to the walk's end.

    Arcs out of a node are tried by ``key``, and after x -> y comes the arc out of y that follows y -> x, in a circle. A walk begins with the
    arc that is marked as ``start``. Places are told by pointer doubling, in as many rounds as the length has binary digits.
    """
    a = numbered(arcs, F.col("x"), F.col("key"), F.col("y"))
    ring = a.groupBy("x").agg(F.min("r").alias("low"), F.count("*").alias("k"))
    a = cut(a.join(ring, "x"))
    follow = a.select(F.col("x").alias("y"), F.col("y").alias("x"), (F.col("low") + (F.col("r") - F.col("low") + 1) % F.col("k")).alias("next"))
    begins = a.filter("start").select(F.col("r").alias("next"), F.lit(True).alias("end"))
    p = a.join(follow, ["x", "y"]).join(begins, "next", "left").select("x", "y", "r", F.when(F.col("end").isNull(), F.col("next")).alias("next"))
    p = cut(p.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    for _ in itertools.count():
        if p.filter("next is not null").isEmpty():
            return p.select("x", "y", "left")
        q = p.select(F.col("r").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        p = cut(p.join(q, "next", "left").select("x", "y", "r", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))


def spanning_order(edges: DataFrame) -> DataFrame:
    """(node, component, parent, place): each tree of the spanning forest walked from its smallest node, the heaviest branch first, then the
    smaller node. A component is named by its smallest node; nodes without edges are not there."""
    forest = spanning_forest(edges)
    home = cut(connected_components(forest))
    both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    arcs = cut(both.select(F.col("u").alias("x"), F.col("v").alias("y"), "weight").join(home.select(F.col("node").alias("x"), F.col("component").alias("root")), "x"))
    first = arcs.filter("x = root").groupBy("x").agg(F.min(F.struct((-F.col("weight")).alias("w"), "y"))["y"].alias("first"))
    arcs = cut(arcs.join(first, "x", "left").withColumn("start", F.coalesce(F.col("y") == F.col("first"), F.lit(False))))
    by_weight = F.struct(F.lit(1).alias("a"), (-F.col("weight").cast("double")).alias("b"))
    walk = tour(arcs.withColumn("key", by_weight))
    back = walk.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("left").alias("back"))
    down = cut(walk.join(back, ["x", "y"]).filter(F.col("left") > F.col("back")).select(F.col("x").alias("parent"), F.col("y").alias("node")))
    up = down.select(F.col("node").alias("x"), F.col("parent").alias("y"), F.lit(True).alias("up"))
    rooted = arcs.join(up, ["x", "y"], "left").withColumn("key", F.when(F.col("up"), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"))).otherwise(by_weight))
    walk = tour(cut(rooted)).join(down.select(F.col("parent").alias("x"), F.col("node").alias("y")), ["x", "y"]).select(F.col("x").alias("parent"), F.col("y").alias("node"), "left")
    roots = home.filter("node = component").select(F.lit(None).cast("long").alias("parent"), "node", F.lit((1 << 63) - 1).alias("left"))
    placed = cut(numbered(walk.unionByName(roots).join(home, "node"), F.col("component"), F.desc("left")))
    zero = placed.groupBy("component").agg(F.min("r").alias("zero"))
    return placed.join(zero, "component").select("node", "component", "parent", (F.col("r") - F.col("zero")).alias("place"))
