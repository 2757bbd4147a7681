"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkweave.plans.lineage import cut


#: Edges up to which each round tells minima by broadcast and keeps few partitions, and edges in one of these.
SMALL, PER_PARTITION = 200_000, 50_000


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node that it reaches.

    Every round hangs the larger neighbours of each node, then the smaller ones, on the smallest; rounds needed grow
    with the logarithm of the longest path. Neighbour minima are aggregates with partial sums and come back by a join, so
    a node with very many edges is not gathered in one task; few edges (a counted bound) are kept in few partitions. Loops and nulls are ignored.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a > b").distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        few = now[0] <= SMALL
        told = F.broadcast if few else lambda x: x
        held = (lambda x, k=now[0] // PER_PARTITION + 1: x.coalesce(k)) if few else lambda x: x
        e = held(e)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(told(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = held(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(told(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        e = cut(held(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()))
    else:
        raise RuntimeError("components did not settle")
    labels = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)
