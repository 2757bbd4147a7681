"""Relations of the analytics and how the given tables play their parts.

* ``placement(read, contig, rev, mapq, coverage, identity, flag)``: where a read of an insert lies; from ``lineitem`` (an
  order is an insert, a part a contig, odd line numbers the reverse strand).
* ``node(node, length)``: from ``part``.
* ``edge(u, v, weight)`` with u < v: undirected; ``cell(col, row, val)``: a sparse matrix by columns, in which an
  undirected graph has both arcs of each edge.
* ``membership(cluster, node)``: clusters may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EDGE_SCHEMA = T.StructType([T.StructField("SOURCE", T.StringType()), T.StructField("TARGET", T.StringType()), T.StructField("RAWWEIGHT", T.DoubleType()), T.StructField("TYPE", T.StringType())])
NODE_SCHEMA = T.StructType([T.StructField("ID", T.StringType()), T.StructField("LENGTH", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("contig"), (F.col("l_linenumber") % 2 == 1).alias("rev"),
        F.col("l_quantity").alias("mapq"), (1 - F.col("l_discount")).alias("coverage"), (100 * (1 - F.col("l_tax"))).alias("identity"), F.col("l_linenumber").alias("flag"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("length"))


def hard_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), F.col("p_type").alias("class"))


def hard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), F.col("p_brand").alias("cluster"))


def soft_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> nation of its suppliers, by quantity supplied."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("class"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obj"), "l_suppkey", F.col("l_quantity").alias("support"))
    return lines.join(supplier, "l_suppkey").groupBy("obj", "class").agg(F.sum("support").alias("support"))


def soft_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obj"), (F.col("l_suppkey") % 10).alias("cluster")).distinct()


def r6(x: Column | str) -> Column:
    """Rounded half up to six places by the same arithmetic in every engine."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5) / 1e6


# SQL for the same relations, to be put before a query's own SELECT
SQL_PLACEMENT = """placement AS (SELECT l_orderkey AS read, l_partkey AS contig, l_linenumber % 2 = 1 AS rev, l_quantity AS mapq,
 1 - l_discount AS coverage, 100 * (1 - l_tax) AS identity, l_linenumber AS flag FROM lineitem)"""
SQL_NODE = "node AS (SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS length FROM part)"
SQL_ARC = f"""{SQL_PLACEMENT}, arc AS (SELECT f.contig AS col, r.contig AS row, CAST(count(*) AS DOUBLE) AS val
 FROM placement f JOIN placement r ON f.read = r.read AND NOT f.rev AND r.rev AND f.contig <> r.contig AND f.mapq >= 10 AND r.mapq >= 10 GROUP BY 1, 2)"""
SQL_EDGE = f"{SQL_ARC}, edge AS (SELECT least(col, row) AS u, greatest(col, row) AS v, sum(val) AS weight FROM arc GROUP BY 1, 2)"
SQL_HEAVY = f"{SQL_EDGE}, heavy AS (SELECT u, v, weight FROM edge WHERE weight >= 2)"
SQL_CELL = f"{SQL_HEAVY}, cell AS (SELECT u AS col, v AS row, weight AS val FROM heavy UNION ALL SELECT v, u, weight FROM heavy)"
SQL_SOFT = """truth AS (SELECT l_partkey AS obj, CAST(s_nationkey AS BIGINT) AS class, sum(l_quantity) AS support FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 clus AS (SELECT DISTINCT l_partkey AS obj, l_suppkey % 10 AS cluster FROM lineitem)"""


def sql6(x: str) -> str:
    return f"floor(({x}) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6"
