"""Text forms of graphs, matrices and clusterings: readers that Spark splits, and writers' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """Lines (``line``) of text files, without blank ones and comments."""
    df = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return df.filter(~F.col("line").startswith(comment)) if comment else df


def fields(line: Column) -> Column:
    """Fields by tab where the line has one, else by white space."""
    return F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, "\\s+"))


def abc(df: DataFrame) -> DataFrame:
    """``a b [w]`` lines -> (a, b, w); w is 1 where it is missing."""
    f = df.select(fields(F.col("line")).alias("f"))
    return f.filter(F.size("f") >= 2).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.coalesce(F.try_element_at("f", F.lit(3)).cast("double"), F.lit(1.0)).alias("w"))


def triples(df: DataFrame, max_col: int | None = None, max_row: int | None = None) -> DataFrame:
    """Numeric ``col row [val]`` lines -> cells, within bounds (exclusive) where given."""
    c = abc(df).select(F.col("a").cast("long").alias("col"), F.col("b").cast("long").alias("row"), F.col("w").alias("val"))
    c = c.filter(F.col("col") < max_col) if max_col is not None else c
    return c.filter(F.col("row") < max_row) if max_row is not None else c


def etc(df: DataFrame) -> DataFrame:
    """``src dst[:v] dst[:v] ...`` lines -> (a, b, w)."""
    f = df.select(fields(F.col("line")).alias("f"))
    pairs = f.select(F.col("f")[0].alias("a"), F.explode(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0)))).alias("t"))
    return pairs.select("a", F.split("t", ":")[0].alias("b"), F.coalesce(F.try_element_at(F.split("t", ":"), F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))


def sif(df: DataFrame) -> DataFrame:
    """``src relation dst ...`` lines -> (a, b, w); the relation is ignored."""
    f = df.select(fields(F.col("line")).alias("f")).filter(F.size("f") >= 3)
    return f.select(F.col("f")[0].alias("a"), F.explode(F.expr("slice(f, 3, size(f) - 2)")).alias("b"), F.lit(1.0).alias("w"))


def merged(df: DataFrame, how: str = "max") -> DataFrame:
    """Repeated (a, b) merged by max, add, mul, or min."""
    f = {"max": F.max("w"), "min": F.min("w"), "add": F.sum("w"), "mul": F.product("w")}[how]
    return df.groupBy("a", "b").agg(f.alias("w"))


def labelled(df: DataFrame, tab: DataFrame, mode: str = "restrict") -> DataFrame:
    """(a, b, w) by label -> cells by id of a dictionary (id, label): ``restrict`` drops unknown labels, ``strict`` raises."""
    if mode == "strict":
        known = tab.select("label")
        unknown = df.select(F.explode(F.array("a", "b")).alias("label")).join(known, "label", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"label not in the dictionary: {unknown[0]['label']}")
    a = tab.select(F.col("label").alias("a"), F.col("id").alias("col"))
    b = tab.select(F.col("label").alias("b"), F.col("id").alias("row"))
    return df.join(a, "a").join(b, "b").select("col", "row", F.col("w").alias("val"))


def metis(df: DataFrame) -> DataFrame:
    """Numbered METIS lines (n = line number from 0; line 0 the header ``N E [fmt]``) -> cells, nodes from 1.

    A format that ends in 1 has weights after each neighbour.
    """
    head = df.filter("n = 0").select(F.coalesce(F.try_element_at(F.split("line", "\\s+"), F.lit(3)), F.lit("0")).alias("fmt"))
    rows = df.filter("n > 0 and line <> ''").withColumn("f", F.split("line", "\\s+")).join(F.broadcast(head))
    pairs = F.when(F.col("fmt").endswith("1"), F.expr("transform(sequence(0, size(f) div 2 - 1), i -> struct(f[2 * i] as b, f[2 * i + 1] as w))")).otherwise(F.transform("f", lambda x: F.struct(x.alias("b"), F.lit("1").alias("w"))))
    return rows.select(F.col("n").alias("col"), F.explode(pairs).alias("p")).select("col", F.col("p.b").cast("long").alias("row"), F.col("p.w").cast("double").alias("val"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of one text file in file order, from 0: the file is read whole as one row, so it must fit a task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("n", "line")).select(F.col("n").cast("long").alias("n"), F.trim("line").alias("line"))


def cluster_lines(df: DataFrame) -> DataFrame:
    """Numbered lines of members -> membership(cluster, node)."""
    return df.filter("line <> ''").select(F.col("n").alias("cluster"), F.explode(F.split("line", "\\s+")).alias("node"))


def written_clusters(membership: DataFrame) -> DataFrame:
    """(cluster, line): each cluster's distinct members, sorted, joined by spaces."""
    return membership.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_set(F.col("node").cast("string"))), " ").alias("line"))


def adjacency(cells: DataFrame) -> DataFrame:
    """(col, line): ``row:val`` of a column in order of rows."""
    entries = F.sort_array(F.collect_list(F.struct("row", F.col("val").cast("long").alias("v"))))
    return cells.groupBy("col").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["row"].cast("string"), F.lit(":"), e["v"].cast("string"))), " ").alias("line"))
