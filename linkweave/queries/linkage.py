"""Linkage graphs, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.functions import cigar
from linkweave.operators import linkage as L, packs as P
from linkweave.registry import query


def edges(spark, sf):
    return L.linkage(M.placements(spark, sf))


def heavy(spark, sf):
    return edges(spark, sf).filter("weight >= 2")


def packs(spark, sf, graph=heavy, most_nodes=None, pack_arcs=None):
    """The graph with both arcs of each edge, by components of up to so many nodes."""
    return P.packed(graph(spark, sf).select(F.col("u").alias("col"), F.col("v").alias("row"), F.col("weight").alias("val")), mirror=True, most_nodes=most_nodes, pack_arcs=pack_arcs)


def graph_query(name, sql, whole_sql=True):
    """Registers a function of (spark, sf, graph) twice: under ``name`` on the heavy edges, to which its SQL is bound, and as
    ``name``_all on all edges, with the same SQL less the weight bound unless that is too slow."""

    def add(f):
        query(name, sql)(f)
        query(f"{name}_all", sql.replace(M.SQL_HEAVY, M.SQL_HEAVY.removesuffix(" WHERE weight >= 2)") + ")") if sql and whole_sql else None)(lambda spark, sf: f(spark, sf, edges))
        return f

    return add


@query("linkage_edges", f"WITH {M.SQL_EDGE}, {M.SQL_NODE} SELECT u, v, weight FROM edge WHERE u IN (SELECT node FROM node WHERE length > 5) AND v IN (SELECT node FROM node WHERE length > 5)")
def linkage_edges(spark, sf):
    return L.among(edges(spark, sf), L.long_nodes(M.nodes(spark, sf), 5)).select("u", "v", "weight")


@query("linkage_arcs", f"WITH {M.SQL_ARC} SELECT * FROM arc")
def linkage_arcs(spark, sf):
    return L.arcs(M.placements(spark, sf))


@query(
    "linkage_edges_all_pairs",
    f"""WITH {M.SQL_PLACEMENT}, n AS (SELECT read, contig, count(*) AS n FROM placement GROUP BY 1, 2)
    SELECT a.contig AS u, b.contig AS v, CAST(sum(CASE WHEN a.contig = b.contig THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS weight
    FROM n a JOIN n b ON a.read = b.read AND a.contig <= b.contig GROUP BY 1, 2 HAVING weight > 0""",
)
def linkage_edges_all_pairs(spark, sf):
    return L.linkage_all_pairs(M.placements(spark, sf))


@query(
    "edge_mean_quality",
    f"""WITH {M.SQL_PLACEMENT} SELECT least(f.contig, r.contig) AS u, greatest(f.contig, r.contig) AS v, count(*) AS weight,
    CAST(floor(avg(least(CAST(60 AS DOUBLE), f.mapq + r.mapq))) AS BIGINT) AS mapq
    FROM placement f JOIN placement r ON f.read = r.read AND NOT f.rev AND r.rev AND f.contig <> r.contig GROUP BY 1, 2""",
)
def edge_mean_quality(spark, sf):
    return L.linkage_quality(M.placements(spark, sf))


@query(
    "paired_ends",
    f"""WITH {M.SQL_PLACEMENT} SELECT read, max(CASE WHEN NOT rev THEN contig END) AS contig1, max(CASE WHEN rev THEN contig END) AS contig2 FROM placement
    GROUP BY read HAVING count(*) FILTER (NOT rev) = 1 AND count(*) FILTER (rev) = 1 AND contig1 <> contig2""",
)
def paired_ends(spark, sf):
    return L.paired_ends(M.placements(spark, sf))


@query("length_filtered_edges", f"WITH {M.SQL_EDGE}, {M.SQL_NODE} SELECT u, v, weight FROM edge WHERE u IN (SELECT node FROM node WHERE length >= 20) AND v IN (SELECT node FROM node WHERE length >= 20)")
def length_filtered_edges(spark, sf):
    return L.among(edges(spark, sf), L.long_nodes(M.nodes(spark, sf), 20, strict=False)).select("u", "v", "weight")


@query("extended_subgraph", f"WITH {M.SQL_EDGE}, {M.SQL_NODE}, k AS (SELECT node FROM node WHERE length > 45) SELECT u, v, weight FROM edge WHERE u IN (SELECT node FROM k) OR v IN (SELECT node FROM k)")
def extended_subgraph(spark, sf):
    return L.touching(edges(spark, sf), L.long_nodes(M.nodes(spark, sf), 45)).select("u", "v", "weight")


@query("coverage_identity_gate", f"WITH {M.SQL_PLACEMENT} SELECT read, contig, count(*) AS n FROM placement WHERE coverage >= CAST(0.955 AS DOUBLE) AND identity >= CAST(95.5 AS DOUBLE) GROUP BY 1, 2")
def coverage_identity_gate(spark, sf):
    return L.gate(M.placements(spark, sf), 0.955, 95.5).groupBy("read", "contig").agg(F.count("*").alias("n"))


@query("drop_light_edges", f"WITH {M.SQL_EDGE}, {M.SQL_NODE}, k AS (SELECT * FROM edge WHERE weight > 1) SELECT node, length FROM node WHERE node IN (SELECT u FROM k UNION SELECT v FROM k)")
def drop_light_edges(spark, sf):
    return L.drop_light(M.nodes(spark, sf), edges(spark, sf), 1)[0]


@graph_query("isolates", f"WITH {M.SQL_HEAVY}, {M.SQL_NODE} SELECT node, length FROM node WHERE node NOT IN (SELECT u FROM heavy UNION SELECT v FROM heavy)")
def isolates(spark, sf, graph=heavy):
    return L.isolates(M.nodes(spark, sf), graph(spark, sf))


@graph_query("self_loops_added", f"WITH {M.SQL_HEAVY}, {M.SQL_NODE} SELECT u, v, weight FROM heavy UNION ALL SELECT node, node, CAST(1 AS DOUBLE) FROM node")
def self_loops_added(spark, sf, graph=heavy):
    return L.with_loops(M.nodes(spark, sf), graph(spark, sf))


@graph_query(
    "hub_removal",
    f"""WITH {M.SQL_HEAVY}, d AS (SELECT node, count(*) AS n FROM (SELECT u AS node FROM heavy UNION ALL SELECT v FROM heavy) GROUP BY 1),
    k AS (SELECT * FROM heavy WHERE u IN (SELECT node FROM d WHERE n <= 3) AND v IN (SELECT node FROM d WHERE n <= 3)),
    r AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT u AS node FROM k UNION SELECT v FROM k))
    SELECT a.i AS u, b.i AS v, weight FROM k JOIN r a ON a.node = u JOIN r b ON b.node = v""",
)
def hub_removal(spark, sf, graph=heavy):
    return L.remove_hubs(graph(spark, sf), 3)


@query("aligned_length", "SELECT l_partkey AS query, l_suppkey AS ref, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_discount <= CAST(0.065 AS DOUBLE) GROUP BY 1, 2")
def aligned_length(spark, sf):
    hits = M.table(spark, sf, "lineitem").filter(F.col("l_discount") <= 0.065)
    return hits.groupBy(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("ref")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query(
    "best_reference",
    """WITH s AS (SELECT l_partkey AS query, l_suppkey AS ref, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2)
    SELECT query, ref, total FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY total DESC, ref) = 1""",
)
def best_reference(spark, sf):
    hits = M.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("ref"), F.col("l_quantity").cast("long").alias("len"))
    return L.best_reference(hits, "query", "ref", "len")


SQL_CIGAR = "c AS (SELECT l_orderkey AS read, l_linenumber AS flag, l_quantity AS mapq, CAST(l_linenumber AS VARCHAR) || 'S' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' || CASE WHEN l_returnflag = 'R' THEN '2D' ELSE '' END || CAST(l_suppkey % 9 + 1 AS VARCHAR) || 'M' AS cigar FROM lineitem)"


def cigars(spark, sf):
    t = M.table(spark, sf, "lineitem")
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("long").cast("string"), F.lit("M"), F.when(F.col("l_returnflag") == "R", "2D").otherwise(""), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit("M"))
    return t.select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("flag"), F.col("l_quantity").alias("mapq"), text.alias("cigar"))


SQL_SUM = "list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+){0}', 1), lambda x: CAST(x AS BIGINT)))"


@query("cigar_coverage_filter", f"WITH {SQL_CIGAR} SELECT read, count(*) AS n, CAST(sum({SQL_SUM.format('M')}) AS BIGINT) AS aligned FROM c WHERE {SQL_SUM.format('M')} / {SQL_SUM.format('[A-Z]')} >= CAST(0.9 AS DOUBLE) AND mapq >= 10 GROUP BY read")
def cigar_coverage_filter(spark, sf):
    c = F.col("cigar")
    good = cigars(spark, sf).filter((cigar.match_coverage(c) >= 0.9) & (F.col("mapq") >= 10))
    return good.groupBy("read").agg(F.count("*").alias("n"), F.sum(cigar.aligned(c)).alias("aligned"))


@query("strong_matches", f"WITH {SQL_CIGAR}, s AS (SELECT read, mapq, flag, substr(cigar, instr(cigar, 'S') + 1) AS cigar FROM c) SELECT read, cigar, count(*) AS n FROM s WHERE flag & 2304 = 0 AND mapq >= 20 AND regexp_matches(cigar, '^[0-9]+M') AND NOT regexp_matches(cigar, '[DNPX]') AND {SQL_SUM.format('M')} >= 30 GROUP BY 1, 2")
def strong_matches(spark, sf):
    s = cigars(spark, sf).withColumn("cigar", F.expr("substr(cigar, instr(cigar, 'S') + 1)"))
    return s.filter(cigar.strong(F.col("cigar"), F.col("flag"), F.col("mapq"), 20, 30)).groupBy("read", "cigar").agg(F.count("*").alias("n"))


SQL_XA = "x AS (SELECT l_orderkey AS read, 'c' || CAST(l_partkey AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || ',' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M,' || CAST(l_linenumber % 2 AS VARCHAR) || ';bad,1;' AS xa FROM lineitem)"


@query("xa_alternates", f"WITH {SQL_XA}, p AS (SELECT read, string_split(unnest(string_split(xa, ';')), ',') AS f FROM x) SELECT read, f[1] AS contig, CAST(f[2] AS BIGINT) AS pos, f[3] AS cigar, count(*) AS n FROM p WHERE len(f) = 4 AND f[4] = '0' GROUP BY ALL")
def xa_alternates(spark, sf):
    t = M.table(spark, sf, "lineitem")
    xa = F.concat(F.lit("c"), F.col("l_partkey").cast("string"), F.lit(","), F.col("l_suppkey").cast("string"), F.lit(","), F.col("l_quantity").cast("long").cast("string"), F.lit("M,"), (F.col("l_linenumber") % 2).cast("string"), F.lit(";bad,1;"))
    hits = t.select(F.col("l_orderkey").alias("read"), F.explode(cigar.alternates(xa)).alias("h")).filter("h.nm = 0")
    return hits.groupBy("read", "h.contig", "h.pos", "h.cigar").agg(F.count("*").alias("n"))


@query("flag_classes", "SELECT l_linenumber & 1 = 1 AS paired, l_linenumber & 2 = 2 AS proper, l_linenumber & 4 = 4 AS unmapped, count(*) AS n, floor(avg(l_quantity) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS mean_mapq FROM lineitem GROUP BY ALL")
def flag_classes(spark, sf):
    bit = lambda b: F.col("l_linenumber").bitwiseAND(F.lit(b)) == b
    return M.table(spark, sf, "lineitem").groupBy(bit(1).alias("paired"), bit(2).alias("proper"), bit(4).alias("unmapped")).agg(F.count("*").alias("n"), M.r6(F.avg("l_quantity")).alias("mean_mapq"))


@query("percent_identity", f"SELECT l_orderkey AS query, l_linenumber AS hit, l_partkey AS ref, {M.sql6('100 * (1 - (l_linenumber + l_suppkey % 3) / (l_quantity + l_linenumber + 2))')} AS identity, count(*) AS n FROM lineitem GROUP BY ALL")
def percent_identity(spark, sf):
    t = M.table(spark, sf, "lineitem")
    pid = cigar.percent_identity(F.col("l_quantity"), F.lit(2), F.col("l_linenumber"), F.col("l_suppkey") % 3)
    return t.groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("hit"), F.col("l_partkey").alias("ref"), M.r6(pid).alias("identity")).agg(F.count("*").alias("n"))


@query("intra_cluster_edges", f"WITH {M.SQL_EDGE} SELECT u, v, weight FROM edge JOIN part a ON a.p_partkey = u JOIN part b ON b.p_partkey = v WHERE a.p_brand = b.p_brand")
def intra_cluster_edges(spark, sf):
    m = M.hard_clusters(spark, sf).withColumnRenamed("obj", "node")
    return L.in_cluster(edges(spark, sf), m).select("u", "v", "weight")


@query("inter_cluster_edges", f"WITH {M.SQL_EDGE} SELECT u, v, weight FROM edge JOIN part a ON a.p_partkey = u JOIN part b ON b.p_partkey = v WHERE a.p_brand <> b.p_brand")
def inter_cluster_edges(spark, sf):
    m = M.hard_clusters(spark, sf).withColumnRenamed("obj", "node")
    return L.in_cluster(edges(spark, sf), m, inside=False).select("u", "v", "weight")


@query("sampled_edges")
def sampled_edges(spark, sf):
    return L.sample_edges(edges(spark, sf), 0.25)


@query("tab_meet_minus_merge", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
  SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS meet, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS minus, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS merge""")
def tab_meet_minus_merge(spark, sf):
    t = M.table(spark, sf, "lineitem").filter("l_returnflag in ('R', 'A')")
    sides = t.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    return sides.agg(F.count_if(F.expr("a and b")).alias("meet"), F.count_if(F.expr("a and not b")).alias("minus"), F.count("*").alias("merge"))


@query("label_paste", "SELECT p_partkey AS node, p_brand AS a, p_type AS b, coalesce(n, 0) AS depth FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def label_paste(spark, sf):
    depth = M.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n"))
    p = M.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    return p.join(depth, "node", "left").select("node", "a", "b", F.coalesce("n", F.lit(0)).alias("depth"))


@query("truth_cluster_join", "SELECT p_partkey AS obj, p_type AS class, p_brand AS cluster FROM part")
def truth_cluster_join(spark, sf):
    return M.hard_truth(spark, sf).join(M.hard_clusters(spark, sf), "obj").select("obj", "class", "cluster")


@query(
    "overlap_sets",
    f"""WITH {M.SQL_SOFT} SELECT a.obj AS o1, b.obj AS o2, count(*) AS shared FROM clus a JOIN clus b ON a.cluster = b.cluster AND a.obj < b.obj
    JOIN part p ON p.p_partkey = a.obj AND p.p_size = 1 JOIN part q ON q.p_partkey = b.obj AND q.p_size = 2 GROUP BY 1, 2""",
)
def overlap_sets(spark, sf):
    c = M.soft_clusters(spark, sf)
    size = M.table(spark, sf, "part").select(F.col("p_partkey").alias("obj"), "p_size")
    a = c.join(size.filter("p_size = 1"), "obj").select("cluster", F.col("obj").alias("o1"))
    b = c.join(size.filter("p_size = 2"), "obj").select("cluster", F.col("obj").alias("o2"))
    return a.join(b, "cluster").filter("o1 < o2").groupBy("o1", "o2").agg(F.count("*").alias("shared"))


@query("overlap_sets_all")
def overlap_sets_all(spark, sf):
    c = M.soft_clusters(spark, sf)
    a, b = (c.select("cluster", F.col("obj").alias(o)) for o in ("o1", "o2"))
    return a.join(b, "cluster").filter("o1 < o2").groupBy("o1", "o2").agg(F.count("*").alias("shared"))


@query("parameter_grid", "SELECT a.r_name || '/' || b.n_name AS path, a.r_name AS region, b.n_name AS nation, CAST(i AS DOUBLE) AS inflation FROM region a, nation b, (VALUES (1.1), (1.4), (2.0)) t(i) WHERE b.n_regionkey = a.r_regionkey")
def parameter_grid(spark, sf):
    from linkweave.plans.sweep import grid

    region = M.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))
    nation = M.table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("nation"))
    return grid(region.join(nation, "k").select("region", "nation"), {"inflation": [1.1, 1.4, 2.0]}, ["region", "nation"])
