"""Clusterings of clusterings: contraction into coarser graphs, orders and stable clusters of a hierarchy, chains of distances.

A hierarchy is levels(level, node, cluster), all levels on the same nodes; a higher level is the coarser one by custom only.
Clusters are compared by the nodes that they share, counted in one pass for all pairs of levels that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from linkweave.operators import markov as K, metrics as C, packs as P, transforms as T
from linkweave.operators.stars import numbered
from linkweave.plans.lineage import cut


def contracted(cells: DataFrame, partition: DataFrame, both_ways: bool = True) -> DataFrame:
    """The graph of clusters: cell [c, d] sums the cells from c's nodes to d's and is divided by c's size; cells within clusters go.
    ``both_ways`` adds the transpose."""
    size = partition.groupBy("cluster").agg(F.count("*").alias("size"))
    a = partition.join(size, "cluster").select(F.col("node").alias("col"), F.col("cluster").alias("c"), "size")
    b = partition.select(F.col("node").alias("row"), F.col("cluster").alias("d"))
    out = cells.join(a, "col").join(b, "row").filter("c <> d").groupBy(F.col("c").alias("col"), F.col("d").alias("row")).agg(F.sum(F.col("val") / F.col("size")).alias("val"))
    return T.symmetrised(out, "add") if both_ways else out


def contraction_levels(cells: DataFrame, nodes: DataFrame, inflation: float = 2.0, most_levels: int = 20, most: int | None = K.MOST) -> DataFrame:
    """levels(level, node, cluster): Markov clustering of the graph, then of the graph of its clusters, and so on until clusters no longer
    grow fewer. Each level's clusters are told for the first graph's nodes, so levels are nested; a node of several
    clusters stays in the smallest."""
    graph, at, out, before = cut(cells), cut(nodes.select("node", F.col("node").alias("cluster"))), None, nodes.count()
    for level in range(1, most_levels + 1):
        names = at.select(F.col("cluster").alias("node")).distinct()
        part = cut(K.enstrict(K.markov_clusters(graph, names, inflation, most=most)))
        at = cut(at.join(part.select(F.col("node").alias("cluster"), F.col("cluster").alias("c")), "cluster").select("node", F.col("c").alias("cluster")))
        now = part.select("cluster").distinct().count()
        if now == before:
            break
        told = at.select(F.lit(level).cast("long").alias("level"), "node", "cluster")
        out, before = (told if out is None else out.unionByName(told)), now
        graph = cut(contracted(graph, part))
        if now == 1 or graph.isEmpty():
            break
    return at.select(F.lit(1).cast("long").alias("level"), "node", "cluster") if out is None else out


def named(levels: DataFrame) -> DataFrame:
    """Adds ``name``, the smallest node of a level's cluster, and ``size``."""
    sizes = levels.groupBy("level", "cluster").agg(F.min("node").alias("name"), F.count("*").alias("size"))
    return levels.join(sizes, ["level", "cluster"])


def leaf_order(levels: DataFrame) -> DataFrame:
    """(node, place): nodes by their clusters from the highest level down, larger clusters first, then the one with the smaller node; so the
    clusters of nested levels are intervals of places. Places are given range by range."""
    step = F.struct((-F.col("level")).alias("l"), (-F.col("size")).alias("s"), "name")
    path = named(levels).groupBy("node").agg(F.sort_array(F.collect_list(step)).alias("path"))  # a step a level
    return numbered(path, F.col("path"), F.col("node")).select("node", F.col("r").alias("place"))


def interval_labels(levels: DataFrame) -> DataFrame:
    """(level, cluster, low, high, size) of the clusters of nested levels in ``leaf_order``; an error where levels are not nested."""
    out = cut(levels.join(leaf_order(levels), "node").groupBy("level", "cluster").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("size")))
    if not out.filter("high - low + 1 <> size").isEmpty():
        raise ValueError("the levels are not nested")
    return out


def shared(levels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l1, l2, c1, c2, n, n1, n2): nodes that clusters share, for pairs (l1, l2) of levels, and the clusters' sizes among shared nodes."""
    a, b = levels.select(F.col("level").alias("l1"), "node", F.col("cluster").alias("c1")), levels.select(F.col("level").alias("l2"), "node", F.col("cluster").alias("c2"))
    n = a.join(F.broadcast(pairs), "l1").join(b, ["l2", "node"]).groupBy("l1", "l2", "c1", "c2").agg(F.count("*").alias("n"))
    one, two = n.groupBy("l1", "l2", "c1").agg(F.sum("n").alias("n1")), n.groupBy("l1", "l2", "c2").agg(F.sum("n").alias("n2"))
    return n.join(one, ["l1", "l2", "c1"]).join(two, ["l1", "l2", "c2"])


def level_pairs(levels: DataFrame, how: str = "chain") -> DataFrame:
    """Pairs (l1, l2) of levels: ``chain``: each with the next; ``first``: the first with all others; ``all``: each with each later one;
    ``coarse``: a chain by falling number of clusters. Levels are few by their role."""
    count = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.countDistinct("cluster").alias("n")).collect()}
    order = sorted(count, key=lambda k: (-count[k], k)) if how == "coarse" else sorted(count)
    pairs = [(order[0], x) for x in order[1:]] if how == "first" else [(x, y) for i, x in enumerate(order) for y in order[i + 1 :]] if how == "all" else list(zip(order, order[1:]))
    return levels.sparkSession.createDataFrame(pairs, "l1 long, l2 long")


def chain_distances(levels: DataFrame, how: str = "chain") -> DataFrame:
    """(l1, l2, split, join, mirkin, vi): distances of pairs of levels, of partitions. ``split`` and ``join`` are the nodes to be moved
    from the first and the second one to their meet, ``mirkin`` ordered pairs of nodes told apart by one alone, ``vi`` in nats."""
    s = cut(shared(levels, level_pairs(levels, how)))
    n, n1, n2 = (F.col(x) for x in ("n", "n1", "n2"))
    most = lambda c: s.groupBy("l1", "l2", c).agg((F.sum("n") - F.max("n")).alias("d")).groupBy("l1", "l2").agg(F.sum("d").alias({"c1": "split", "c2": "join"}[c]))
    # a cluster's squared size is the sum over its cells of their count times it
    rest = s.groupBy("l1", "l2").agg(F.sum(n * n1 + n * n2 - 2 * n * n).alias("mirkin"), (F.sum(n * (F.ln(n1 / n) + F.ln(n2 / n))) / F.sum(n)).alias("vi"))
    return most("c1").join(most("c2"), ["l1", "l2"]).join(rest, ["l1", "l2"])


def stable_clusters(levels: DataFrame) -> DataFrame:
    """(name, size, first, last): clusters that stay the same from level to level, by their smallest node: each longest run of levels."""
    order = W.partitionBy("name", "size").orderBy("level")  # a row a level
    same = shared(levels, level_pairs(levels)).filter("n = n1 and n = n2").select(F.col("l2").alias("level"), F.col("c2").alias("cluster"), F.lit(0).alias("new"))
    c = named(levels).select("level", "cluster", "name", "size").distinct().join(same, ["level", "cluster"], "left")
    run = c.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(order))
    return run.groupBy("name", "size", "run").agg(F.min("level").alias("first"), F.max("level").alias("last")).drop("run")


def projected(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clusters cut down to some nodes; empty ones go."""
    return membership.join(nodes.select("node").distinct(), "node", "left_semi").select("cluster", "node")


def trivial(nodes: DataFrame, how: str = "bottom") -> DataFrame:
    """``top``: all nodes in one cluster, named by the smallest; ``bottom``: each in its own."""
    if how == "bottom":
        return nodes.select(F.col("node").alias("cluster"), "node")
    return nodes.select("node").join(F.broadcast(nodes.agg(F.min("node").alias("cluster"))), F.lit(True)).select("cluster", "node")  # one row


def inflation_sweep(cells: DataFrame | P.Packs, nodes: DataFrame, inflations: list[float], truth: DataFrame, most: int | None = K.MOST) -> DataFrame:
    """A row an inflation: number of clusters, of single nodes, size of the largest, rounds taken, mean mass kept in the worst round, and
    homogeneity, completeness and v of the partition against truth(node, class)."""
    rows, spark = [], nodes.sparkSession
    cells, truth = P.packed(cells, most_nodes=K.pack_nodes(most)), cut(truth.select(F.col("node").alias("obj"), "class"))
    for r in inflations:
        flow = K.markov_flow(cells, r, most=most)
        part = cut(K.enstrict(K.interpret(flow.cells, nodes)))
        sizes = part.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*"), F.count_if(F.col("n") == 1), F.max("n")).first()
        v = C.v_measure(C.contingency(truth, part.select(F.col("node").alias("obj"), "cluster"), "class", "cluster"), "class", "cluster").first()
        rows.append((float(r), *sizes, len(flow.rounds), min((x[4] for x in flow.rounds), default=1.0), v["homogeneity"], v["completeness"], v["v"]))
    return spark.createDataFrame(rows, "inflation double, clusters long, single long, largest long, rounds long, mass double, homogeneity double, completeness double, v double")
