"""Assigning nodes to clusters by their arcs; overlapping covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def residue(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, cluster, weight): each node's cluster of greatest arc weight; ties go to the smaller cluster."""
    p = cells.join(membership.select("cluster", F.col("node").alias("row")), "row").groupBy("col", "cluster").agg(F.sum("val").alias("weight"))
    best = F.row_number().over(W.partitionBy("col").orderBy(F.desc("weight"), "cluster"))
    return p.withColumn("k", best).filter("k = 1").select(F.col("col").alias("node"), "cluster", "weight")


def relevance(cells: DataFrame) -> DataFrame:
    """(node, relevance): half the share of neighbours with no larger degree plus half the share with no larger mean weight."""
    e = cells.filter("col <> row")
    own = e.groupBy("col").agg(F.count("*").alias("d"), F.avg("val").alias("m"))
    other = own.select(F.col("col").alias("row"), F.col("d").alias("d2"), F.col("m").alias("m2"))
    j = e.join(own, "col").join(other, "row").groupBy("col", "d").agg(F.count_if(F.col("d2") <= F.col("d")).alias("a"), F.count_if(F.col("m") >= F.col("m2")).alias("b"))
    return j.select(F.col("col").alias("node"), (0.5 * (F.col("a") + F.col("b")) / F.col("d")).alias("relevance"))


def soft_partition(cells: DataFrame, partition: DataFrame, method: str = "simple") -> DataFrame:
    """membership(cluster, node, w): a partition made overlapping along cut edges.

    ``simple``: each end of a cut edge also belongs to the other end's cluster, with weight 1/2. ``maxaff``: only along a node's
    strongest cut edges.
    """
    a = partition.select(F.col("node").alias("col"), F.col("cluster").alias("c1"))
    b = partition.select(F.col("node").alias("row"), F.col("cluster").alias("c2"))
    cut = cells.join(a, "col").join(b, "row").filter("c1 <> c2")
    if method == "maxaff":
        most = cut.groupBy("col").agg(F.max("val").alias("most"))
        cut = cut.join(most, "col").filter("val = most")
    extra = cut.select(F.col("c2").alias("cluster"), F.col("col").alias("node")).distinct().withColumn("w", F.lit(0.5))
    return partition.select("cluster", "node", F.lit(1.0).alias("w")).unionByName(extra)
