"""Graphs and clusterings turned into the line formats of other tools, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from linkweave.plans.lineage import cut


def node_map(nodes: DataFrame) -> DataFrame:
    """(node, id): distinct nodes numbered from 1 in their order, range by range; only one row a range is put in order
    in one task."""
    ordered = cut(nodes.select("node").distinct().sort("node")).withColumn("part", F.spark_partition_id())
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    return ordered.join(F.broadcast(before), "part").select("node", (F.col("before") + nth).alias("id"))


def metis_lines(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(n, line) of undirected edges (u, v, weight) without repetition: line 0 ``N E 1``, line n the neighbours and whole
    weights of node n of the map; nodes without edges have empty lines."""
    met = edges.join(ids.toDF("u", "i"), "u").join(ids.toDF("v", "j"), "v").select("i", "j", F.col("weight").cast("long").alias("w"))
    arcs = met.unionByName(met.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("j", "w"))), lambda e: F.concat_ws(" ", e["j"].cast("string"), e["w"].cast("string")))
    rows = arcs.groupBy(F.col("i").alias("n")).agg(F.array_join(entries, " ").alias("line"))
    rows = ids.select(F.col("id").alias("n")).join(rows, "n", "left").select("n", F.coalesce("line", F.lit("")).alias("line"))
    head = ids.agg(F.count("*").alias("a")).crossJoin(met.agg(F.count("*").alias("b")))  # one row each
    return rows.unionByName(head.select(F.lit(0).cast("long").alias("n"), F.concat_ws(" ", "a", "b", F.lit("1")).alias("line")))


def metis_clusters(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbered lines (n from 1: node n) of cluster numbers -> membership(cluster, node); a node may stand in several, one without
    any gets a cluster of its own, of the negative of its number."""
    named = df.join(ids.withColumnRenamed("id", "n"), "n")
    held = F.filter(F.split(F.trim("line"), "\\s+"), lambda x: x != "")
    clusters = F.when(F.size(held) > 0, F.transform(held, lambda x: x.cast("long"))).otherwise(F.array(-F.col("n").cast("long")))
    return named.select(F.explode(clusters).alias("cluster"), "node").distinct()


def column_clusters(df: DataFrame) -> DataFrame:
    """Numbered lines ``cluster`` (of the node of the line's number) or ``node cluster`` -> membership(cluster, node), as text."""
    f = F.split(F.trim("line"), "\\s+")
    node = F.when(F.size(f) > 1, f[0]).otherwise(F.col("n").cast("string"))
    return df.filter(F.trim("line") != "").select(F.coalesce(F.get(f, F.lit(1)), f[0]).alias("cluster"), node.alias("node"))


def inverse_weights(edges: DataFrame) -> DataFrame:
    """Weights turned to 1 / weight; null for 0."""
    return edges.withColumn("weight", 1 / F.nullif(F.col("weight").cast("double"), F.lit(0.0)))


def node_attributes(membership: DataFrame) -> DataFrame:
    """(node, cluster, cluster_size) by a count of each cluster that is joined back."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    return membership.join(sizes, "cluster").select("node", "cluster", "cluster_size")


def repeated_labels(tab: DataFrame) -> DataFrame:
    """(label, n) of labels that stand more than once in a dictionary (id, label)."""
    return tab.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
