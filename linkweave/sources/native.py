"""Native text matrices, and edge and node tables of the pipeline.

A native matrix file has a header with its dimensions, may list the ids of its columns and rows, and holds one vector a column: the
column's id, then ``row`` or ``row:value`` for each cell, over any number of lines, up to a ``$``. Spark's text reader takes that sign as its
separator, so a file of any size is split at vector boundaries and each record is one vector. A column's id is parsed before its cells
are, so a filter on ``col`` drops vectors unread. Comments run from ``#`` to the end of the line and hold no ``$``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkweave.model import EDGE_SCHEMA, NODE_SCHEMA

#: Rows that a written line of a vector spans.
SPAN = 4096
DOMAIN = r"(?s)^.*\(mcl(cols|rows|doms)\s+([^()]*)$"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the parts of files between ``$`` signs, without comments."""
    return spark.read.option("lineSep", "$").text(path).select(F.regexp_replace("value", "#[^\\n]*", "").alias("text"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(col, cells): a row a vector, its cells as text."""
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?s)^.*\bbegin\b", ""), r"\s+", " "))
    v = records(spark, path).filter(~F.col("text").rlike(DOMAIN)).select(body.alias("body")).filter(F.col("body").rlike(r"^\d"))
    return v.select(F.substring_index("body", " ", 1).cast("long").alias("col"), F.expr("substr(body, instr(body || ' ', ' ') + 1)").alias("cells"))


def read_matrix(spark: SparkSession, path: str, cols: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """cell(col, row, val) of native matrix files; a missing value is 1. ``cols`` and ``rows`` (tables of ``node``) ask for a part of it:
    other vectors are dropped before their cells are parsed."""
    v = vectors(spark, path)
    if cols is not None:
        v = v.join(cols.select(F.col("node").alias("col")).distinct(), "col", "left_semi")
    c = v.filter("cells <> ''").select("col", F.explode(F.split("cells", " ")).alias("c")).select("col", F.split("c", ":").alias("c")).select("col", F.col("c")[0].cast("long").alias("row"), F.coalesce(F.get("c", F.lit(1)).cast("double"), F.lit(1.0)).alias("val"))
    return c if rows is None else c.join(rows.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("col", "row", "val")


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(rows, cols): the dimensions that the header tells; no cells are read beyond the first record."""
    d = F.regexp_extract("text", r"dimensions\s+(\d+)x(\d+)", 1), F.regexp_extract("text", r"dimensions\s+(\d+)x(\d+)", 2)
    return records(spark, path).filter(F.col("text").rlike(r"dimensions\s+\d+x\d+")).limit(1).select(d[0].cast("long").alias("rows"), d[1].cast("long").alias("cols"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(side, node): ids of ``cols`` and ``rows`` that the file lists, or numbers up to its dimensions where it lists none."""
    listed = records(spark, path).select(F.regexp_extract("text", DOMAIN, 1).alias("kind"), F.regexp_extract("text", DOMAIN, 2).alias("ids")).filter("kind <> ''")
    listed = listed.select(F.explode(F.when(F.col("kind") == "doms", F.array(F.lit("cols"), F.lit("rows"))).otherwise(F.array("kind"))).alias("side"), F.split(F.trim(F.regexp_replace("ids", r"\s+", " ")), " ").alias("ids"))
    listed = listed.select("side", F.explode(F.transform(F.filter("ids", lambda x: x != ""), lambda x: x.cast("long"))).alias("node"))
    size = read_dimensions(spark, path).select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("cols", "rows")])).alias("x")).select("x.*").filter("n > 0")
    counted = size.join(listed.select("side").distinct(), "side", "left_anti").select("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node"))
    return listed.unionByName(counted)


def placed_lines(cells: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(k, col, part, line): lines of a native matrix and their places in the file by (k, col, part): the header, listed ids, vectors, the end."""
    c = cells.withColumn("part", F.floor(F.col("row") / SPAN).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "val"))), lambda x: F.concat_ws(":", x["row"].cast("string"), number(x["val"]))), " ")
    parts = c.groupBy("col", "part").agg(text.alias("text"))
    edge = c.groupBy("col").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    lead = F.when(F.col("part") == F.col("low"), F.concat(F.col("col").cast("string"), F.lit(" "))).otherwise(F.lit("   "))
    body = parts.join(edge, "col").select(F.lit(2).alias("k"), "col", "part", F.concat(lead, "text", F.when(F.col("part") == F.col("high"), " $").otherwise("")).alias("line"))
    ids = cells.select(F.explode(F.array("col", "row")).alias("node")) if nodes is None else nodes.select("node").distinct()
    n, most = ids.agg(F.count("*"), F.coalesce(F.max("node"), F.lit(-1))).first()
    counted = nodes is None or n == most + 1
    size = most + 1 if counted else n
    spark = cells.sparkSession
    head = [(0, 0, 0, f"(mclheader\nmcltype matrix\ndimensions {size}x{size}\n)")] + ([] if counted else [(0, 0, 1, "(mcldoms")]) + [(1, 1 << 62, 0, "(mclmatrix\nbegin" if counted else "$\n)\n(mclmatrix\nbegin"), (3, 0, 0, ")")]
    out = body.unionByName(spark.createDataFrame(head, "k int, col long, part long, line string"))
    if not counted:
        listed = ids.groupBy(F.floor(F.col("node") / SPAN).cast("long").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), " ").alias("line"))
        out = out.unionByName(listed.select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("col"), "part", "line"))
    return out


def matrix_lines(cells: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(line) of a native matrix, in the order of the file: one line for ``SPAN`` rows of a column, so no line grows with a column. ``nodes``
    (both domains) are written as a list unless they are the numbers from 0; without them the numbers up to the largest id are meant."""
    return placed_lines(cells, nodes).sort("k", "col", "part").select("line")


def number(x: Column) -> Column:
    """A value as text: whole numbers without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def write_matrix(cells: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """Writes ``matrix_lines`` as part files, which follow one another by name. Ranges are of columns, and all that stands before the first one is
    one range, so neither a vector nor the list of ids is split between files."""
    lines = placed_lines(cells, nodes).withColumn("file", F.when(F.col("k") == 2, F.col("col")).when(F.col("k") < 2, -1).otherwise(F.lit(1 << 62)))
    lines.repartitionByRange("file").sortWithinPartitions("k", "col", "part").select("line").write.text(path)


def read_edges(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Edges with a header, SOURCE TARGET RAWWEIGHT TYPE, of fixed types; a line that doesn't fit is an error."""
    return spark.read.csv(path, EDGE_SCHEMA, sep=sep, header=True, mode="FAILFAST")


def read_nodes(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Nodes with a header, ID LENGTH, of fixed types; a line that doesn't fit is an error."""
    return spark.read.csv(path, NODE_SCHEMA, sep=sep, header=True, mode="FAILFAST")


def edge_table(edges: DataFrame, kind: str = "UNDIRECTED") -> DataFrame:
    """edge(u, v, weight) as the columns of edge files."""
    return edges.select(F.col("u").cast("string").alias("SOURCE"), F.col("v").cast("string").alias("TARGET"), F.col("weight").cast("double").alias("RAWWEIGHT"), F.lit(kind).alias("TYPE"))


def node_table(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").cast("string").alias("ID"), F.col("length").cast("int").alias("LENGTH"))


def write_table(df: DataFrame, path: str, sep: str = " ") -> None:
    df.write.csv(path, sep=sep, header=True)


def dump_lines(cells: DataFrame, part: str = "all", values: bool = True, sep: str = "\t", tab: DataFrame | None = None) -> DataFrame:
    """(col, row, line) of a matrix as pairs: ``part`` is all, upper (col < row), upperi (and loops), lower, loweri or noloop; ``values`` writes
    the value too; ``tab`` (id, label) writes labels, and an id without one as ``?``."""
    test = {"all": "true", "upper": "col < row", "upperi": "col <= row", "lower": "col > row", "loweri": "col >= row", "noloop": "col <> row"}[part]
    c = cells.filter(test)
    for side in ("col", "row"):
        c = c.withColumn(f"{side}_text", F.col(side).cast("string")) if tab is None else c.join(tab.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label")), side, "left").withColumn(f"{side}_text", F.coalesce(f"{side}_label", F.lit("?")))
    return c.select("col", "row", F.concat_ws(sep, "col_text", "row_text", *([number(F.col("val"))] if values else [])).alias("line"))
