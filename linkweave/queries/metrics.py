"""Clustering comparison. Hard: part types against brands; soft: supplier nations against supplier groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import metrics as C
from linkweave.registry import query

HARD = "tab AS (SELECT p_type AS class, p_brand AS cluster, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY class) AS nx, sum(n) OVER (PARTITION BY cluster) AS ny, sum(n) OVER () AS total FROM tab)"
ENT = f"""{HARD}, e AS (SELECT -sum(n / total * ln(n / ny)) AS hxy, -sum(n / total * ln(n / nx)) AS hyx, sum(n / total * log2(n * total / (nx * ny))) AS mi FROM s),
 hx AS (SELECT -sum(a / total * ln(a / total)) AS h, -sum(a / total * log2(a / total)) AS h2 FROM (SELECT DISTINCT class, nx AS a, total FROM s)),
 hy AS (SELECT -sum(a / total * ln(a / total)) AS h, -sum(a / total * log2(a / total)) AS h2 FROM (SELECT DISTINCT cluster, ny AS a, total FROM s))"""


def hard(spark, sf):
    return C.contingency(M.hard_truth(spark, sf), M.hard_clusters(spark, sf), "class", "cluster")


def six(df, *names):
    return df.withColumns({n: M.r6(n) for n in names})


@query("crosstab", f"WITH {HARD} SELECT c.class, k.cluster, coalesce(n, 0) AS n FROM (SELECT DISTINCT class FROM tab) c CROSS JOIN (SELECT DISTINCT cluster FROM tab) k LEFT JOIN tab ON tab.class = c.class AND tab.cluster = k.cluster")
def crosstab(spark, sf):
    return C.full_crosstab(M.hard_truth(spark, sf), M.hard_clusters(spark, sf), "class", "cluster")


@query("hard_truth", f"WITH {M.SQL_SOFT} SELECT obj, class, support FROM truth QUALIFY row_number() OVER (PARTITION BY obj ORDER BY support DESC, class) = 1")
def hard_truth(spark, sf):
    return C.hard_assignment(M.soft_truth(spark, sf))


@query("supported_truth", f"WITH {M.SQL_SOFT} SELECT obj, count(*) AS classes, sum(support) AS support FROM truth WHERE CAST(support AS BIGINT) >= 40 GROUP BY obj")
def supported_truth(spark, sf):
    t = M.soft_truth(spark, sf).filter(F.col("support").cast("long") >= 40)
    return t.groupBy("obj").agg(F.count("*").alias("classes"), F.sum("support").alias("support"))


@query("label_tally", f"WITH {M.SQL_SOFT} SELECT class, count(*) AS n, {M.sql6('count(*) / sum(count(*)) OVER ()')} AS share FROM truth GROUP BY class")
def label_tally(spark, sf):
    return six(C.label_tally(M.soft_truth(spark, sf)), "share")


@query("truth_size_stats", f"WITH {M.SQL_SOFT}, k AS (SELECT obj, count(*) AS n FROM truth GROUP BY obj) SELECT {M.sql6('avg(n)')} AS mean, {M.sql6('stddev_pop(n)')} AS sd, CAST(max(n) AS BIGINT) AS most FROM k")
def truth_size_stats(spark, sf):
    k = M.soft_truth(spark, sf).groupBy("obj").agg(F.count("*").alias("n"))
    return k.agg(M.r6(F.avg("n")).alias("mean"), M.r6(F.stddev_pop("n")).alias("sd"), F.max("n").alias("most"))


@query("bcubed_hard", f"WITH {HARD}, q AS (SELECT sum(n * n / ny) / sum(n) AS pre, sum(n * n / nx) / sum(n) AS rec FROM s) SELECT {M.sql6('pre')} AS pre, {M.sql6('rec')} AS rec, {M.sql6('2 * pre * rec / (pre + rec)')} AS f FROM q")
def bcubed_hard(spark, sf):
    return six(C.bcubed_hard(hard(spark, sf), "class", "cluster"), "pre", "rec", "f")


@query(
    "bcubed_soft",
    f"""WITH {M.SQL_SOFT}, t AS (SELECT obj, list_sort(list(DISTINCT class)) AS ts FROM truth GROUP BY obj), k AS (SELECT obj, list_sort(list(DISTINCT cluster)) AS cs FROM clus GROUP BY obj),
    o AS (SELECT ts, cs, count(*) AS n FROM t JOIN k USING (obj) GROUP BY 1, 2),
    p AS (SELECT a.ts, a.cs, a.n, sum(b.n * least(len(list_intersect(a.ts, b.ts)), len(list_intersect(a.cs, b.cs))) / len(list_intersect(a.cs, b.cs))) / sum(b.n) AS m FROM o a JOIN o b ON list_has_any(a.cs, b.cs) GROUP BY 1, 2, 3),
    r AS (SELECT a.ts, a.cs, a.n, sum(b.n * least(len(list_intersect(a.ts, b.ts)), len(list_intersect(a.cs, b.cs))) / len(list_intersect(a.ts, b.ts))) / sum(b.n) AS m FROM o a JOIN o b ON list_has_any(a.ts, b.ts) GROUP BY 1, 2, 3),
    x AS (SELECT (SELECT sum(m * n) / sum(n) FROM p) AS pre, (SELECT sum(m * n) / sum(n) FROM r) AS rec, (SELECT count(*) FROM t JOIN k USING (obj)) / (SELECT count(*) FROM (SELECT obj FROM t UNION SELECT obj FROM k)) AS completeness)
    SELECT {M.sql6('pre')} AS pre, {M.sql6('rec')} AS rec, {M.sql6('2 * pre * rec / (pre + rec)')} AS f, {M.sql6('completeness')} AS completeness FROM x""",
)
def bcubed_soft(spark, sf):
    return six(C.bcubed_soft(M.soft_truth(spark, sf), M.soft_clusters(spark, sf)), "pre", "rec", "f", "completeness")


@query("v_measure", f"WITH {ENT}, q AS (SELECT 1 - hxy / hx.h AS hom, 1 - hyx / hy.h AS com FROM e, hx, hy) SELECT {M.sql6('hom')} AS homogeneity, {M.sql6('com')} AS completeness, {M.sql6('2 * hom * com / (hom + com)')} AS v FROM q")
def v_measure(spark, sf):
    return six(C.v_measure(hard(spark, sf), "class", "cluster"), "homogeneity", "completeness", "v")


@query("nmi", f"WITH {ENT} SELECT {M.sql6('mi')} AS mi, {M.sql6('hx.h2')} AS h_x, {M.sql6('hy.h2')} AS h_y, {M.sql6('2 * mi / (hx.h2 + hy.h2)')} AS nmi FROM e, hx, hy")
def nmi(spark, sf):
    return six(C.nmi(hard(spark, sf), "class", "cluster"), "mi", "h_x", "h_y", "nmi")


@query("variation_of_information", f"WITH {ENT} SELECT {M.sql6('greatest(hyx, 0)')} AS d1, {M.sql6('greatest(hxy, 0)')} AS d2 FROM e")
def variation_of_information(spark, sf):
    return six(C.variation_of_information(hard(spark, sf), "class", "cluster"), "d1", "d2")


@query("split_join_distance", f"WITH {HARD} SELECT CAST((SELECT sum(d) FROM (SELECT sum(n) - max(n) AS d FROM tab GROUP BY class)) AS BIGINT) AS d1, CAST((SELECT sum(d) FROM (SELECT sum(n) - max(n) AS d FROM tab GROUP BY cluster)) AS BIGINT) AS d2")
def split_join_distance(spark, sf):
    return C.split_join(hard(spark, sf), "class", "cluster")


@query("mirkin_distance", f"WITH {HARD} SELECT CAST((SELECT sum(a * a) FROM (SELECT sum(n) AS a FROM tab GROUP BY class)) - sum(n * n) AS BIGINT) AS d1, CAST((SELECT sum(a * a) FROM (SELECT sum(n) AS a FROM tab GROUP BY cluster)) - sum(n * n) AS BIGINT) AS d2 FROM tab")
def mirkin_distance(spark, sf):
    return C.mirkin(hard(spark, sf), "class", "cluster")


@query(
    "rand_indices",
    f"""WITH {HARD}, q AS (SELECT (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM tab GROUP BY class)) AS a, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM tab GROUP BY cluster)) AS b,
    sum(n * (n - 1) / 2) AS ab, sum(n) * (sum(n) - 1) / 2 AS t FROM tab)
    SELECT {M.sql6('(t + 2 * ab - a - b) / t')} AS rand, {M.sql6('(ab - a * b / t) / ((a + b) / 2 - a * b / t)')} AS adjusted_rand, {M.sql6('ab / (a + b - ab)')} AS jaccard FROM q""",
)
def rand_indices(spark, sf):
    return six(C.pair_counts(hard(spark, sf), "class", "cluster"), "rand", "adjusted_rand", "jaccard")


@query(
    "fowlkes_mallows",
    f"""WITH {M.SQL_SOFT}, tc AS (SELECT obj, cluster AS i, class AS j FROM clus JOIN truth USING (obj)),
    pc AS (SELECT sum(n * (n - 1)) AS v FROM (SELECT count(*) AS n FROM tc GROUP BY i, j)),
    qc AS (SELECT sum(n * (n - 1)) AS v FROM (SELECT count(*) AS n FROM tc a JOIN tc b ON a.obj = b.obj AND a.i < b.i AND a.j < b.j GROUP BY a.i, a.j, b.i, b.j)),
    pt AS (SELECT sum(n * (n - 1)) - (SELECT sum(m * (m - 1)) FROM (SELECT count(*) AS m FROM truth a JOIN truth b ON a.obj = b.obj AND a.class < b.class GROUP BY a.class, b.class)) AS v FROM (SELECT count(*) AS n FROM truth GROUP BY class)),
    pk AS (SELECT sum(n * (n - 1)) - (SELECT sum(m * (m - 1)) FROM (SELECT count(*) AS m FROM clus a JOIN clus b ON a.obj = b.obj AND a.cluster < b.cluster GROUP BY a.cluster, b.cluster)) AS v FROM (SELECT count(*) AS n FROM clus GROUP BY cluster))
    SELECT {M.sql6('CAST(pc.v - qc.v AS DOUBLE) / sqrt(CAST(pt.v AS DOUBLE) * CAST(pk.v AS DOUBLE))')} AS gfm FROM pc, qc, pt, pk""",
)
def fowlkes_mallows(spark, sf):
    return six(C.fowlkes_mallows(M.soft_truth(spark, sf), M.soft_clusters(spark, sf)), "gfm")


@query("volatile_nodes", f"WITH {HARD} SELECT f AS share, CAST(sum(CASE WHEN n < f * nx AND n < f * ny THEN n ELSE 0 END) AS BIGINT) AS n FROM s, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) v(f) GROUP BY f")
def volatile_nodes(spark, sf):
    return C.volatile(hard(spark, sf), "class", "cluster", [0.05, 0.2, 0.5])


@query("node_volatility", f"WITH n AS (SELECT p_partkey AS obj, 1 / count(*) OVER (PARTITION BY p_brand, p_type) + 1 / count(*) OVER (PARTITION BY p_brand, p_size) + 1 / count(*) OVER (PARTITION BY p_type, p_size) AS s FROM part) SELECT obj, {M.sql6('s')} AS score FROM n")
def node_volatility(spark, sf):
    p = M.table(spark, sf, "part")
    return six(C.volatility([p.select(F.col("p_partkey").alias("obj"), F.col(c).cast("string").alias("cluster")) for c in ("p_brand", "p_type", "p_size")]), "score")


@query("cluster_meet", "SELECT p_partkey AS obj, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size // 10) AS part FROM part")
def cluster_meet(spark, sf):
    p = M.table(spark, sf, "part").withColumn("band", F.expr("p_size div 10").cast("string"))
    return C.meet([p.select(F.col("p_partkey").alias("obj"), F.col(c).alias("cluster")) for c in ("p_brand", "p_type", "band")])


@query("cluster_mate", f"WITH {HARD} SELECT class, cluster, n AS meet, CAST(nx - n AS BIGINT) AS xdiff, CAST(ny - n AS BIGINT) AS ydiff, {M.sql6('2 * n / (nx + ny)')} AS score FROM s")
def cluster_mate(spark, sf):
    return six(C.mate(hard(spark, sf), "class", "cluster"), "score")


@query("best_match_f", f"WITH {HARD}, b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY 2 * n / (nx + ny) DESC, class) AS r FROM s) SELECT cluster, class, CAST(ny AS BIGINT) AS size, {M.sql6('2 * n / (nx + ny)')} AS f, {M.sql6('n / ny')} AS pre, {M.sql6('n / nx')} AS rec FROM b WHERE r = 1")
def best_match_f(spark, sf):
    return six(C.best_match(hard(spark, sf), "class", "cluster"), "f", "pre", "rec")


@query(
    "best_match_p",
    f"""WITH {HARD}, q AS (SELECT cluster, class, (lgamma(total + 1) - lgamma(ny + 1) - lgamma(total - ny + 1) - lgamma(nx + 1) + lgamma(n + 1) + lgamma(nx - n + 1)
    - lgamma(total - nx + 1) + lgamma(ny - n + 1) + lgamma(total - nx - ny + n + 1)) / ln(CAST(10 AS DOUBLE)) AS score FROM s)
    SELECT cluster, class, {M.sql6('score')} AS score FROM q QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, class) = 1""",
)
def best_match_p(spark, sf):
    return six(C.hypergeometric_score(hard(spark, sf), "class", "cluster"), "score")


@query("matched_f1")
def matched_f1(spark, sf):
    return six(C.matched_f1(hard(spark, sf), "class", "cluster"), "pre", "rec", "f1")
