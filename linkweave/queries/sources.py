"""Text formats read from lines that Spark writes out of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import transforms as T
from linkweave.plans.lineage import shared_folder
from linkweave.queries.linkage import edges
from linkweave.registry import query
from linkweave.sources import alignments as A, converters as C, native


def tabbed(df, *columns):
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") if c in df.columns else F.expr(c).cast("string") for c in columns]).alias("line"))


def lineitem(spark, sf):
    return M.table(spark, sf, "lineitem")


@query(
    "sam_records",
    """SELECT CAST(l_orderkey AS VARCHAR) AS read, CAST(l_partkey AS VARCHAR) AS contig, CAST(l_suppkey AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS mapq,
    l_linenumber || 'M' AS cigar FROM lineitem WHERE l_linenumber % 2 = 1""",
)
def sam_records(spark, sf):
    lines = tabbed(
        lineitem(spark, sf), "l_orderkey", "case when l_linenumber % 2 = 1 then 16 else 272 end", "l_partkey", "l_suppkey", "cast(l_quantity as bigint)",
        "concat(l_linenumber, 'M')", "'*'", "0", "0", "'*'", "'*'",
    )
    return A.sam(lines.unionByName(spark.createDataFrame([("@HD\tVN:1.6",)], "line string"))).select("read", "contig", "pos", "mapq", "cigar")


@query(
    "psl_coverage",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS q_name, CAST(l_partkey AS VARCHAR) AS t_name,
    {M.sql6("CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 100")} AS coverage FROM lineitem""",
)
def psl_coverage(spark, sf):
    lines = tabbed(
        lineitem(spark, sf), "cast(l_quantity as bigint)", "0", "0", "0", "0", "0", "0", "0", "'+'", "l_orderkey", "100", "l_linenumber",
        "l_linenumber + cast(l_quantity as bigint)", "l_partkey", "1000", "0", "50", "1", "'50,'", "'0,'", "'0,'",
    )
    found = A.psl(lines.unionByName(spark.createDataFrame([("psLayout version 3",)], "line string")))
    return found.select("q_name", "t_name", M.r6(A.alignment_coverage(F.col("q_start"), F.col("q_end"), F.col("q_size"))).alias("coverage"))


@query(
    "last_best_scores",
    "SELECT CAST(l_orderkey AS VARCHAR) AS q_name, max(CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY 1",
)
def last_best_scores(spark, sf):
    lines = tabbed(lineitem(spark, sf), "cast(l_quantity as bigint)", "l_partkey", "0", "9", "'+'", "90", "l_orderkey", "0", "9", "'+'", "9", "'9'")
    return A.last_tab(lines.unionByName(spark.createDataFrame([("# LAST",), (" ",)], "line string"))).groupBy("q_name").agg(F.max("score").alias("score"))


@query(
    "blast_pairs",
    """SELECT least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS a, greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS b,
    CAST(max(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2""",
)
def blast_pairs(spark, sf):
    return A.blast_abc(tabbed(lineitem(spark, sf), "l_partkey", "l_suppkey", "99.5", "100", "0", "0", "1", "100", "1", "100", "1e-9", "cast(l_quantity as bigint)"))


@query(
    "vcf_snps",
    """SELECT CAST(l_partkey AS VARCHAR) AS chrom, CAST(l_orderkey AS BIGINT) AS pos, l_returnflag AS ref FROM lineitem
    WHERE l_returnflag = 'A' AND l_linenumber % 3 = 0""",
)
def vcf_snps(spark, sf):
    lines = tabbed(lineitem(spark, sf), "l_partkey", "l_orderkey", "'.'", "l_returnflag", "case l_linenumber % 3 when 0 then 'G' when 1 then 'G,T' else 'GT' end", "9", "'PASS'", "'.'")
    return A.snps(lines.unionByName(spark.createDataFrame([("##fileformat=VCFv4.2",)], "line string"))).select("chrom", "pos", "ref")


@query("fasta_sizes", "SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(length(replace(p_name, ' ', '')) AS BIGINT) AS length FROM part")
def fasta_sizes(spark, sf):
    return A.fasta_lengths(M.table(spark, sf, "part").select(F.expr("concat(p_partkey, ' x\n', replace(p_name, ' ', '\n'), '\n')").alias("value")))


@query(
    "contact_normalised",
    f"""WITH {M.SQL_EDGE}, n AS (SELECT p_partkey AS node, p_size AS length, c AS depth FROM part JOIN
    (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON p_partkey = l_partkey WHERE p_size > 0),
    s AS (SELECT node, CAST(length AS DOUBLE) / (SELECT max(length) FROM n) * depth / (SELECT quantile_cont(depth, 0.5) FROM n) AS size FROM n)
    SELECT u, v, {M.sql6("weight / sqrt(a.size * b.size)")} AS weight FROM edge JOIN s a ON u = a.node JOIN s b ON v = b.node""",
)
def contact_normalised(spark, sf):
    depth = lineitem(spark, sf).groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.when(F.col("l_linenumber") > 1, 1)).alias("depth"))
    found = A.normalised_contacts(edges(spark, sf), M.nodes(spark, sf).join(depth, "node"))
    return found.select("u", "v", M.r6("weight").alias("weight"))


SQL_IDS = f"{M.SQL_EDGE}, ids AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT u AS node FROM edge UNION SELECT v FROM edge))"


def edge_nodes(found):
    return found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node")))


@query("metis_node_map", f"WITH {SQL_IDS} SELECT node, id FROM ids")
def metis_node_map(spark, sf):
    return C.node_map(edge_nodes(edges(spark, sf)))


@query(
    "metis_graph_lines",
    f"""WITH {SQL_IDS}, arcs AS (SELECT a.id AS i, b.id AS j, CAST(weight AS BIGINT) AS w FROM edge JOIN ids a ON u = a.node JOIN ids b ON v = b.node)
    SELECT i AS n, string_agg(j || ' ' || w, ' ' ORDER BY j) AS line FROM (SELECT * FROM arcs UNION ALL SELECT j, i, w FROM arcs) GROUP BY 1
    UNION ALL SELECT 0, (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) FROM edge) || ' 1'""",
)
def metis_graph_lines(spark, sf):
    found = edges(spark, sf)
    return C.metis_lines(found, C.node_map(edge_nodes(found)))


@query("inverse_edge_weights", f"WITH {M.SQL_EDGE} SELECT u, v, {M.sql6('1 / weight')} AS weight FROM edge")
def inverse_edge_weights(spark, sf):
    return C.inverse_weights(edges(spark, sf)).select("u", "v", M.r6("weight").alias("weight"))


@query("cluster_attributes", "SELECT p_partkey AS node, p_brand AS cluster, count(*) OVER (PARTITION BY p_brand) AS cluster_size FROM part")
def cluster_attributes(spark, sf):
    return C.node_attributes(M.hard_clusters(spark, sf).withColumnRenamed("obj", "node"))


@query("repeated_labels", "SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1 HAVING n > 1")
def repeated_labels(spark, sf):
    return C.repeated_labels(M.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


@query("cluster_column_lines", "SELECT CAST(p_size AS VARCHAR) AS cluster, CAST(p_partkey AS VARCHAR) AS node FROM part")
def cluster_column_lines(spark, sf):
    return C.column_clusters(M.table(spark, sf, "part").selectExpr("p_partkey as n", "case when p_partkey % 2 = 0 then cast(p_size as string) else concat(p_partkey, '\t', p_size) end as line"))


@query(
    "metis_cluster_lists",
    "SELECT DISTINCT CASE WHEN p_size <= 5 THEN -p_partkey ELSE unnest([CAST(p_size AS BIGINT), p_size % 7]) END AS cluster, p_partkey AS node FROM part",
)
def metis_cluster_lists(spark, sf):
    part = M.table(spark, sf, "part")
    lines = part.selectExpr("p_partkey as n", "case when p_size <= 5 then '' else concat(p_size, ' ', p_size % 7) end as line")
    return C.metis_clusters(lines, part.selectExpr("p_partkey as node", "p_partkey as id"))


SQL_CELLS = f"WITH {M.SQL_EDGE}, cell AS (SELECT u AS col, v AS row, weight AS val FROM edge UNION ALL SELECT v, u, weight FROM edge)"


def native_file(spark, sf):
    """The linkage graph, written as a native matrix into the shared folder."""
    path = shared_folder(spark, "matrix")
    native.write_matrix(T.mirrored(edges(spark, sf)), path, M.nodes(spark, sf))
    return path


@query("native_matrix", f"{SQL_CELLS} SELECT col, row, val FROM cell")
def native_matrix(spark, sf):
    return native.read_matrix(spark, native_file(spark, sf))


@query("native_submatrix", f"{SQL_CELLS} SELECT col, row, val FROM cell WHERE col IN (SELECT p_partkey FROM part WHERE p_size > 40) AND row IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def native_submatrix(spark, sf):
    size = M.nodes(spark, sf)
    return native.read_matrix(spark, native_file(spark, sf), size.filter("length > 40"), size.filter("length < 20"))


@query("native_skeleton", "SELECT side, p_partkey AS node FROM part, (VALUES ('cols'), ('rows')) s(side)")
def native_skeleton(spark, sf):
    return native.read_domains(spark, native_file(spark, sf))


@query("edge_file", f"WITH {M.SQL_EDGE} SELECT CAST(u AS VARCHAR) AS \"SOURCE\", CAST(v AS VARCHAR) AS \"TARGET\", weight AS \"RAWWEIGHT\", 'UNDIRECTED' AS \"TYPE\" FROM edge")
def edge_file(spark, sf):
    path = shared_folder(spark, "edges")
    native.write_table(native.edge_table(edges(spark, sf)), path)
    return native.read_edges(spark, path)


@query("node_file", "SELECT CAST(p_partkey AS VARCHAR) AS \"ID\", p_size AS \"LENGTH\" FROM part")
def node_file(spark, sf):
    path = shared_folder(spark, "nodes")
    native.write_table(native.node_table(M.nodes(spark, sf)), path)
    return native.read_nodes(spark, path)


@query("dumped_pairs", f"{SQL_CELLS} SELECT col, row, a.p_brand || '/' || col || chr(9) || b.p_brand || '/' || row || chr(9) || CAST(CAST(val AS BIGINT) AS VARCHAR) AS line FROM cell JOIN part a ON a.p_partkey = col JOIN part b ON b.p_partkey = row WHERE col < row")
def dumped_pairs(spark, sf):
    tab = M.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("label"))
    return native.dump_lines(T.mirrored(edges(spark, sf)), "upper", tab=tab)


@query(
    "backbone_extents",
    """WITH f AS (SELECT l_orderkey AS a, l_orderkey + CAST(l_quantity AS BIGINT) AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE 0 END AS c, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 7 ELSE 0 END AS d,
    CASE WHEN l_linenumber % 3 = 0 THEN -l_suppkey ELSE l_suppkey END AS e, CASE WHEN l_linenumber % 3 = 0 THEN -l_suppkey - l_linenumber ELSE l_suppkey + l_linenumber END AS g FROM lineitem),
    n AS (SELECT *, CAST(a > 0 AS INT) + CAST(c > 0 AS INT) + CAST(e > 0 AS INT) AS n_way FROM f), x AS (SELECT 0 AS genome, a AS l, b AS r, n_way FROM n UNION ALL SELECT 1, c, d, n_way FROM n UNION ALL SELECT 2, e, g, n_way FROM n)
    SELECT CAST(genome AS BIGINT) AS genome, CAST(n_way AS BIGINT) AS n_way, CAST(sum(abs(r - l)) AS BIGINT) AS extent FROM x WHERE l > 0 GROUP BY genome, n_way""",
)
def backbone_extents(spark, sf):
    even, third = "l_linenumber % 2 = 0", "l_linenumber % 3 = 0"
    lines = tabbed(
        lineitem(spark, sf), "l_orderkey", "l_orderkey + cast(l_quantity as bigint)", f"if({even}, l_partkey, 0)", f"if({even}, l_partkey + 7, 0)",
        f"if({third}, -l_suppkey, l_suppkey)", f"if({third}, -l_suppkey - l_linenumber, l_suppkey + l_linenumber)",
    )
    header = spark.createDataFrame([("seq0_leftend\tseq0_rightend\tseq1_leftend\tseq1_rightend\tseq2_leftend\tseq2_rightend",)], "line string")
    return A.backbone(lines.unionByName(header), 3).groupBy("genome", "n_way").agg(F.sum("extent").alias("extent"))


@query("coverage_table", "SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS DOUBLE) AS depth, p_size / CAST(100 AS DOUBLE) AS gc FROM part")
def coverage_table(spark, sf):
    lines = tabbed(M.table(spark, sf, "part"), "concat(p_partkey, ' ', p_brand)", "p_size", "0", "0", "0", "0", "0", "0", "cast(p_size / 100 as double)")
    return A.coverage_table(lines.unionByName(spark.createDataFrame([("#ID\tAvg_fold",)], "line string")))
