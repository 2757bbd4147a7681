"""Hierarchies of clusterings: parts by brand, type and size, by brand and type, by brand, by maker (the brand's first digit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import hierarchy as H, markov as K, transforms as T
from linkweave.queries.linkage import edges, packs
from linkweave.registry import query

KEYS = [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand"], ["substr(p_brand, 1, 7)"]]
SQL_LEVELS = "lev AS (" + " UNION ALL ".join(f"SELECT {i} AS level, p_partkey AS node, concat_ws('|', {', '.join(k)}) AS cluster FROM part" for i, k in enumerate(KEYS, 1)) + "), nam AS (SELECT *, min(node) OVER w AS name, count(*) OVER w AS size FROM lev WINDOW w AS (PARTITION BY level, cluster))"


def levels(spark, sf):
    p = M.table(spark, sf, "part")
    out = None
    for i, keys in enumerate(KEYS, 1):
        one = p.select(F.lit(i).cast("long").alias("level"), F.col("p_partkey").alias("node"), F.concat_ws("|", *[F.expr(k).cast("string") for k in keys]).alias("cluster"))
        out = one if out is None else out.unionByName(one)
    return out


SQL_ORDER = f"{SQL_LEVELS}, ord AS (SELECT a.node, row_number() OVER (ORDER BY d.size DESC, d.name, c.size DESC, c.name, b.size DESC, b.name, a.size DESC, a.name, a.node) - 1 AS place FROM nam a JOIN nam b ON a.node = b.node AND b.level = 2 JOIN nam c ON c.node = a.node AND c.level = 3 JOIN nam d ON d.node = a.node AND d.level = 4 WHERE a.level = 1)"


@query("leaf_order", f"WITH {SQL_ORDER} SELECT node, place FROM ord")
def leaf_order(spark, sf):
    return H.leaf_order(levels(spark, sf))


@query("interval_labels", f"WITH {SQL_ORDER} SELECT CAST(level AS BIGINT) AS level, cluster, min(place) AS low, max(place) AS high, count(*) AS size FROM lev JOIN ord USING (node) GROUP BY level, cluster")
def interval_labels(spark, sf):
    return H.interval_labels(levels(spark, sf))


SQL_SHARED = f"""{SQL_LEVELS}, sh AS (SELECT l1, l2, c1, c2, n, sum(n) OVER (PARTITION BY l1, l2, c1) AS n1, sum(n) OVER (PARTITION BY l1, l2, c2) AS n2 FROM (SELECT a.level AS l1, b.level AS l2, a.cluster AS c1, b.cluster AS c2, count(*) AS n
 FROM lev a JOIN lev b ON a.node = b.node AND {{0}} GROUP BY 1, 2, 3, 4))"""
SQL_CHAIN = f"""WITH {SQL_SHARED}, s1 AS (SELECT l1, l2, sum(d) AS split FROM (SELECT l1, l2, sum(n) - max(n) AS d FROM sh GROUP BY l1, l2, c1) GROUP BY 1, 2), s2 AS (SELECT l1, l2, sum(d) AS j FROM (SELECT l1, l2, sum(n) - max(n) AS d FROM sh GROUP BY l1, l2, c2) GROUP BY 1, 2)
 SELECT CAST(l1 AS BIGINT) AS l1, CAST(l2 AS BIGINT) AS l2, CAST(any_value(split) AS BIGINT) AS split, CAST(any_value(j) AS BIGINT) AS "join", CAST(sum(n * n1 + n * n2 - 2 * n * n) AS BIGINT) AS mirkin, {M.sql6('sum(n * (ln(n1 / n) + ln(n2 / n))) / sum(n)')} AS vi FROM sh JOIN s1 USING (l1, l2) JOIN s2 USING (l1, l2) GROUP BY 1, 2"""


@query("chain_distances", SQL_CHAIN.format("b.level = a.level + 1"))
def chain_distances(spark, sf):
    return H.chain_distances(levels(spark, sf)).withColumn("vi", M.r6("vi"))


@query("chain_distances_all_pairs", SQL_CHAIN.format("b.level > a.level"))
def chain_distances_all_pairs(spark, sf):
    return H.chain_distances(levels(spark, sf), "all").withColumn("vi", M.r6("vi"))


@query("stable_clusters", f"""WITH {SQL_SHARED.format("b.level = a.level + 1")}, u AS (SELECT DISTINCT level, cluster, name, size FROM nam), k AS (SELECT u.*, CASE WHEN c2 IS NULL THEN 1 ELSE 0 END AS new FROM u LEFT JOIN (SELECT * FROM sh WHERE n = n1 AND n = n2) s ON s.l2 = u.level AND s.c2 = u.cluster),
 r AS (SELECT *, sum(new) OVER (PARTITION BY name, size ORDER BY level) AS run FROM k) SELECT name, size, CAST(min(level) AS BIGINT) AS first, CAST(max(level) AS BIGINT) AS last FROM r GROUP BY name, size, run""")
def stable_clusters(spark, sf):
    return H.stable_clusters(levels(spark, sf))


@query("projected_clusters", "SELECT p_brand AS cluster, p_partkey AS node FROM part WHERE p_size > 25")
def projected_clusters(spark, sf):
    part = M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))
    return H.projected(part, M.nodes(spark, sf).filter("length > 25"))


@query("contracted_graph", f"WITH {M.SQL_EDGE}, cell AS (SELECT u AS col, v AS row, weight AS val FROM edge UNION ALL SELECT v, u, weight FROM edge), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), c AS (SELECT a.p_brand AS col, b.p_brand AS row, sum(val) / any_value(n) AS val FROM cell JOIN part a ON a.p_partkey = col JOIN part b ON b.p_partkey = row JOIN n ON n.p_brand = a.p_brand WHERE a.p_brand <> b.p_brand GROUP BY 1, 2) SELECT col, row, {M.sql6('sum(val)')} AS val FROM (SELECT * FROM c UNION ALL SELECT row, col, val FROM c) GROUP BY 1, 2")
def contracted_graph(spark, sf):
    part = M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))
    return H.contracted(T.mirrored(edges(spark, sf)), part).withColumn("val", M.r6("val"))


@query("contraction_levels")
def contraction_levels(spark, sf):
    return H.contraction_levels(T.mirrored(edges(spark, sf)), M.nodes(spark, sf))


@query("inflation_sweep")
def inflation_sweep(spark, sf):
    truth = M.hard_truth(spark, sf).select(F.col("obj").alias("node"), "class")
    return H.inflation_sweep(packs(spark, sf, edges, K.pack_nodes(K.MOST)), M.nodes(spark, sf), [1.4, 2.0, 4.0], truth)
