"""Graph and clustering statistics, windows, intervals and contact maps.

Events give positions: a user is a contig, seconds since the first day the position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import bins as B, stats as A, transforms as T
from linkweave.queries.linkage import edges, graph_query, heavy
from linkweave.registry import ORACLE, query


def cells(spark, sf, graph=heavy):
    return T.mirrored(graph(spark, sf))


def members(spark, sf):
    return M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))


def six(df, *names):
    return df.withColumns({n: M.r6(n) for n in names})


s6 = M.sql6
SQL_MEMBER = "member AS (SELECT p_brand AS cluster, p_partkey AS node FROM part)"
SQL_FULLCELL = f"{M.SQL_EDGE}, cell AS (SELECT u AS col, v AS row, weight AS val FROM edge UNION ALL SELECT v, u, weight FROM edge), {SQL_MEMBER}"
SQL_SITE = "site AS (SELECT user_id AS contig, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS pos, event_type, value FROM events)"


def full_cells(spark, sf):
    return T.mirrored(edges(spark, sf))


def sites(spark, sf):
    pos = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).cast("long")
    return M.table(spark, sf, "events").select(F.col("user_id").alias("contig"), pos.alias("pos"), "event_type", "value")


@query("column_stats", f"WITH {SQL_FULLCELL} SELECT col, count(*) AS n, sum(val) AS sum, max(val) AS max, min(val) AS min, {s6('avg(val)')} AS mean FROM cell GROUP BY col")
def column_stats(spark, sf):
    return six(A.column_stats(full_cells(spark, sf)), "mean")


@graph_query("degree_stats", f"WITH {M.SQL_CELL}, d AS (SELECT p_partkey AS node, count(col) AS d FROM part LEFT JOIN cell ON col = p_partkey GROUP BY 1) SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, count(*) FILTER (d = 0) AS isolates, {s6('avg(d)')} AS mean, median(d) AS median FROM d")
def degree_stats(spark, sf, graph=heavy):
    return six(A.degree_stats(M.nodes(spark, sf), graph(spark, sf)), "mean")


@query("edge_weight_spread", f"WITH {M.SQL_EDGE} SELECT {s6('avg(weight)')} AS mean, {s6('stddev_pop(weight)')} AS sd, quantile_cont(weight, 0.5) AS median, quantile_cont(weight, 0.75) - quantile_cont(weight, 0.25) AS iqr FROM edge")
def edge_weight_spread(spark, sf):
    return six(A.spread(edges(spark, sf), "weight"), "mean", "sd")


@query("granularity", """WITH s AS (SELECT p_partkey % 40 * (p_size % 3) AS cluster, count(*) AS size FROM part GROUP BY 1), o AS (SELECT size, sum(size) OVER w AS held, row_number() OVER w AS k FROM s WINDOW w AS (ORDER BY size DESC, cluster ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT min(k) AS k FROM o WHERE 2 * held >= (SELECT sum(size) FROM s))
 SELECT count(*) AS n, max(size) AS max, floor(sum(size * size) / sum(size) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS ctr, floor(avg(size) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS avg, min(size) AS min, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size <= 4) AS quartletons,
 (SELECT k FROM h) AS twi, (SELECT size FROM o WHERE k = (SELECT k FROM h)) AS twl FROM s""")
def granularity(spark, sf):
    m = M.table(spark, sf, "part").select((F.col("p_partkey") % 40 * (F.col("p_size") % 3)).alias("cluster"), F.col("p_partkey").alias("node"))
    return six(A.granularity(m), "ctr", "avg")


@query("cluster_performance", f"WITH {SQL_FULLCELL}, o AS (SELECT a.cluster, col, sum(val) AS si FROM cell JOIN member a ON a.node = col JOIN member b ON b.node = row AND b.cluster = a.cluster GROUP BY 1, 2), e AS (SELECT col, sum(val) AS s FROM cell GROUP BY 1) SELECT {s6('avg(coalesce(si / s, 0))')} AS mass_fraction, {s6('(SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM member GROUP BY cluster)) / (count(*) * (count(*) - 1))')} AS area_fraction FROM member m LEFT JOIN o ON o.col = m.node LEFT JOIN e ON e.col = m.node")
def cluster_performance(spark, sf):
    return six(A.performance(full_cells(spark, sf), members(spark, sf)), "mass_fraction", "area_fraction")


@query("cluster_density", f"WITH {SQL_FULLCELL}, i AS (SELECT a.cluster, sum(val) AS w FROM cell JOIN member a ON a.node = col JOIN member b ON b.node = row AND b.cluster = a.cluster GROUP BY 1) SELECT cluster, size, {s6('coalesce(w, 0) / (size * (size - 1))')} AS density FROM (SELECT cluster, count(*) AS size FROM member GROUP BY 1) LEFT JOIN i USING (cluster)")
def cluster_density(spark, sf):
    return six(A.cluster_density(full_cells(spark, sf), members(spark, sf)), "density")


SQL_CUT = f"{SQL_FULLCELL}, k AS (SELECT a.cluster, sum(val) AS volume, sum(CASE WHEN a.cluster <> b.cluster THEN val ELSE 0 END) AS cut FROM cell JOIN member a ON a.node = col JOIN member b ON b.node = row GROUP BY 1), z AS (SELECT *, sum(volume) OVER () AS total FROM k)"


@query("conductance", f"WITH {SQL_CUT} SELECT cluster, {s6('cut / volume')} AS ncut, {s6('cut / least(volume, total - volume)')} AS conductance FROM z")
def conductance(spark, sf):
    return six(A.conductance(full_cells(spark, sf), members(spark, sf)), "ncut", "conductance")


@query("normalised_cut", f"WITH {SQL_CUT} SELECT {s6('sum(cut / volume)')} AS ncut, sum(cut) / 2 AS cut FROM z")
def normalised_cut(spark, sf):
    c = A.cuts(full_cells(spark, sf), members(spark, sf))
    return c.agg(M.r6(F.sum(F.col("cut") / F.col("volume"))).alias("ncut"), (F.sum("cut") / 2).alias("cut"))


@query("modularity", f"WITH {SQL_CUT} SELECT {s6('sum((volume - cut) / total - power(volume / total, 2))')} AS modularity FROM z")
def modularity(spark, sf):
    return six(A.modularity(full_cells(spark, sf), members(spark, sf)), "modularity")


@graph_query("node_cluster_scores", f"WITH {M.SQL_CELL}, {SQL_MEMBER}, e AS (SELECT col, sum(val) AS s FROM cell GROUP BY 1) SELECT c.col, cluster, count(*) AS n, sum(val) AS weight, {s6('sum(val) / any_value(s)')} AS share FROM cell c JOIN member ON node = row JOIN e ON e.col = c.col GROUP BY 1, 2")
def node_cluster_scores(spark, sf, graph=heavy):
    return six(A.node_scores(cells(spark, sf, graph), members(spark, sf)), "share")


@graph_query("residue_assignment", f"WITH {M.SQL_CELL}, {SQL_MEMBER}, p AS (SELECT col, cluster, sum(val) AS weight FROM cell JOIN member ON node = row GROUP BY 1, 2) SELECT col AS node, cluster, weight FROM p QUALIFY row_number() OVER (PARTITION BY col ORDER BY weight DESC, cluster) = 1")
def residue_assignment(spark, sf, graph=heavy):
    from linkweave.operators.cover import residue

    return residue(cells(spark, sf, graph), members(spark, sf))


@query("clustering_sanity", f"WITH {M.SQL_SOFT}, k AS (SELECT node, count(cluster) AS k FROM (SELECT p_partkey AS node FROM part) LEFT JOIN (SELECT obj, cluster FROM clus WHERE cluster < 4) ON obj = node GROUP BY 1) SELECT count(*) FILTER (k = 0) AS missing, count(*) FILTER (k > 1) AS overlap, CAST(sum(greatest(k - 1, 0)) AS BIGINT) AS excess FROM k")
def clustering_sanity(spark, sf):
    m = M.soft_clusters(spark, sf).filter("cluster < 4").select("cluster", F.col("obj").alias("node"))
    return A.sanity(M.nodes(spark, sf), m)


@query("clustering_sanity_all", ORACLE["clustering_sanity"].replace(" WHERE cluster < 4", ""))
def clustering_sanity_all(spark, sf):
    return A.sanity(M.nodes(spark, sf), M.soft_clusters(spark, sf).select("cluster", F.col("obj").alias("node")))


@query("weight_histogram", f"WITH {M.SQL_EDGE} SELECT CAST(floor(log2(weight)) AS BIGINT) AS bin, count(*) AS n FROM edge GROUP BY 1")
def weight_histogram(spark, sf):
    return A.log2_histogram(edges(spark, sf), "weight")


@query("price_histogram", "SELECT CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 11 ELSE floor((l_quantity - 5) / 4) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def price_histogram(spark, sf):
    return A.histogram(M.table(spark, sf, "lineitem"), "l_quantity", 5, 45, 10)


@query("scale_free_fit", f"WITH {SQL_FULLCELL}, d AS (SELECT count(*) AS d FROM cell GROUP BY col), b AS (SELECT d, count(*) AS k FROM d GROUP BY 1), c AS (SELECT d, sum(k) OVER (ORDER BY d DESC) AS c FROM b) SELECT {s6('power(corr(ln(d), ln(c)), 2)')} AS r2 FROM c")
def scale_free_fit(spark, sf):
    return six(A.scale_free_fit(full_cells(spark, sf).groupBy("col").agg(F.count("*").alias("d")), "d"), "r2")


@query("assembly_entropy", f"WITH k AS (SELECT l_partkey AS contig, l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT c.contig, coalesce(n, 0) + 1 AS x FROM (SELECT DISTINCT contig FROM k) c CROSS JOIN (SELECT DISTINCT source FROM k) s LEFT JOIN k ON k.contig = c.contig AND k.source = s.source), h AS (SELECT contig, log2(sum(x)) - sum(x * log2(x)) / sum(x) AS h FROM f GROUP BY 1) SELECT {s6('sum(h * p_size) / sum(p_size)')} AS entropy FROM h JOIN part ON p_partkey = contig")
def assembly_entropy(spark, sf):
    k = M.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("contig"), F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"))
    return six(A.source_entropy(k, M.nodes(spark, sf).withColumnRenamed("node", "contig")), "entropy")


@query("nway_shared_rollup", "WITH t AS (SELECT l_quantity AS q, l_returnflag <> 'R' AS a, l_linestatus = 'O' AS b, l_linenumber % 2 = 0 AS c FROM lineitem), u AS (SELECT CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS n, q, unnest(list_filter([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END], lambda x: x IS NOT NULL)) AS genome FROM t) SELECT coalesce(CAST(n AS BIGINT), -1) AS n, coalesce(genome, 'all') AS genome, sum(q) AS extent FROM u GROUP BY CUBE (n, genome)")
def nway_shared_rollup(spark, sf):
    t = M.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_returnflag") != "R").alias("a"), (F.col("l_linestatus") == "O").alias("b"), (F.col("l_linenumber") % 2 == 0).alias("c"))
    return A.shared_extent(t, ["a", "b", "c"], "q")


@query("alignment_summary", f"SELECT l_returnflag AS kind, count(*) AS n, {s6('avg(l_quantity)')} AS mean, {s6('stddev_pop(l_quantity)')} AS sd, quantile_cont(l_quantity, 0.5) AS p50, count(*) FILTER (l_discount = 0) AS full_matches FROM lineitem GROUP BY 1")
def alignment_summary(spark, sf):
    q = F.col("l_quantity")
    return six(M.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("sd"), F.percentile(q, 0.5).alias("p50"), F.count_if(F.col("l_discount") == 0).alias("full_matches")), "mean", "sd")


@query("snp_ratio", f"SELECT user_id AS contig, event_type AS site, count(*) FILTER (value < 50) AS ref, count(*) FILTER (value >= 50) AS var, {s6('count(*) FILTER (value >= 50) / count(*)')} AS ratio, count(*) AS depth FROM events GROUP BY 1, 2")
def snp_ratio(spark, sf):
    from linkweave.operators.variants import allele_ratio

    e = M.table(spark, sf, "events").select(F.col("user_id").alias("contig"), F.col("event_type").alias("site"), (F.col("value") >= 50).alias("is_var"))
    return six(allele_ratio(e), "ratio")


@query("contig_offsets", "SELECT p_partkey AS contig, CAST(p_size AS BIGINT) AS length, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM part".replace("offset_ FROM", '"offset" FROM'))
def contig_offsets(spark, sf):
    return B.offsets(M.nodes(spark, sf).withColumnRenamed("node", "contig"))


@query("site_bins", f"WITH {SQL_SITE}, s AS (SELECT contig, pos, row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n FROM (SELECT DISTINCT contig, pos FROM site)), b AS (SELECT *, greatest(1, n // 10 + CASE WHEN n % 10 >= 5 AND n > 10 THEN 1 ELSE 0 END) AS bins FROM s) SELECT contig, pos, CAST(CASE WHEN bins = 1 AND n < 12 THEN -1 ELSE floor(i * bins / n) END AS BIGINT) AS bin FROM b")
def site_bins(spark, sf):
    return B.site_bins(sites(spark, sf).select("contig", "pos").distinct(), 10, 12)


@query("restriction_fragments", f"WITH {SQL_SITE}, s AS (SELECT DISTINCT contig, pos FROM site) SELECT contig, pos AS start, n AS stop FROM (SELECT *, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS n FROM s) WHERE n IS NOT NULL")
def restriction_fragments(spark, sf):
    return B.fragments(sites(spark, sf))


@query("split_segments", f"""WITH {SQL_SITE}, s AS (SELECT DISTINCT contig, pos FROM site WHERE event_type = 'error'), l AS (SELECT contig, max(pos) + 10 AS length FROM site GROUP BY 1),
 a AS (SELECT contig, lag(pos, 1, 0) OVER (PARTITION BY contig ORDER BY pos) + 1 AS start, pos - 1 AS stop FROM s UNION ALL SELECT s.contig, max(pos) + 1, any_value(length) FROM s JOIN l ON l.contig = s.contig GROUP BY 1) SELECT contig, start, stop FROM a WHERE start <= stop""")
def split_segments(spark, sf):
    s = sites(spark, sf)
    return B.segments(s.filter("event_type = 'error'"), s.groupBy("contig").agg((F.max("pos") + 10).alias("length")))


@query("asof_nearest_site", f"""WITH {SQL_SITE}, c AS (SELECT DISTINCT contig, pos FROM site WHERE event_type = 'error'), q AS (SELECT contig, pos, value FROM site WHERE event_type <> 'error')
 SELECT q.contig, q.pos, q.value, coalesce((SELECT max(c.pos) FROM c WHERE c.contig = q.contig AND c.pos <= q.pos), (SELECT max(c.pos) FROM c WHERE c.contig = q.contig)) AS site FROM q""")
def asof_nearest_site(spark, sf):
    s = sites(spark, sf)
    return B.nearest_below(s.filter("event_type <> 'error'").select("contig", "pos", "value"), s.filter("event_type = 'error'"))


@query("covered_runs", f"WITH {SQL_SITE}, c AS (SELECT DISTINCT contig, pos // 20000 AS pos FROM site), g AS (SELECT *, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM c) SELECT contig, min(pos) AS start, max(pos) AS stop FROM g GROUP BY contig, g")
def covered_runs(spark, sf):
    return B.runs(sites(spark, sf).select("contig", F.expr("pos div 20000").alias("pos")))


SQL_SPAN = f"{SQL_SITE}, span AS (SELECT contig, pos AS start, pos + CAST(floor(value) AS BIGINT) * 100 AS stop, event_type FROM site)"


def spans(spark, sf):
    return sites(spark, sf).select("contig", F.col("pos").alias("start"), (F.col("pos") + F.floor("value") * 100).alias("stop"), "event_type")


@query("merged_intervals", f"WITH {SQL_SPAN}, b AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM span), g AS (SELECT *, sum(CASE WHEN start <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT contig, min(start) AS start, max(stop) AS stop FROM g GROUP BY contig, g")
def merged_intervals(spark, sf):
    return B.merged_intervals(spans(spark, sf).select("contig", "start", "stop"))


@query("variant_pileup", f"WITH {SQL_SPAN} SELECT s.contig, s.pos, count(*) AS n FROM site s JOIN span i ON i.contig = s.contig AND s.pos BETWEEN i.start AND i.stop WHERE s.event_type = 'error' GROUP BY 1, 2")
def variant_pileup(spark, sf):
    p = sites(spark, sf).filter("event_type = 'error'").select("contig", "pos")
    return B.covering(p, spans(spark, sf).select("contig", "start", "stop"), 5_000).groupBy("contig", "pos").agg(F.count("*").alias("n"))


@query("interval_overlaps", f"WITH {SQL_SPAN} SELECT a.contig, count(*) AS n FROM (SELECT * FROM span WHERE event_type = 'error') a JOIN (SELECT * FROM span WHERE event_type <> 'error') b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop GROUP BY 1")
def interval_overlaps(spark, sf):
    s = spans(spark, sf).withColumn("id", F.xxhash64("contig", "start", "stop", "event_type"))
    return B.overlapping(s.filter("event_type = 'error'"), s.filter("event_type <> 'error'"), 5_000).groupBy("contig").agg(F.count("*").alias("n"))


SQL_HIT = "hit AS (SELECT l_orderkey AS query, l_suppkey % 3 AS ref, CAST(l_linenumber * 3 AS BIGINT) AS start, CAST(l_linenumber * 3 + l_quantity AS BIGINT) AS stop, 100 * (1 - l_tax) AS identity, 60 AS size FROM lineitem)"


@query("masked_coverage", f"WITH {SQL_HIT}, g AS (SELECT * FROM hit WHERE identity >= 94), b AS (SELECT query, ref, unnest(range(start, stop)) AS p, identity, size FROM g), m AS (SELECT query, ref, p, max(identity) AS i, any_value(size) AS size FROM b GROUP BY 1, 2, 3), s AS (SELECT query, ref, sum(i) / 100 / any_value(size) AS score FROM m GROUP BY 1, 2) SELECT query, ref, {s6('score')} AS score FROM s WHERE score > CAST(0.7 AS DOUBLE)")
def masked_coverage(spark, sf):
    line = F.col("l_linenumber").cast("long") * 3
    h = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 3).alias("ref"), line.alias("start"), (line + F.col("l_quantity").cast("long")).alias("stop"), (100 * (1 - F.col("l_tax"))).alias("identity"), F.lit(60).alias("size"))
    return six(B.masked_coverage(h, 94, 0.7), "score")


SQL_MAP = f"{M.SQL_PLACEMENT}, b AS (SELECT read, rev, contig // 50 AS bin FROM placement), map AS (SELECT least(f.bin, r.bin) AS bin_i, greatest(f.bin, r.bin) AS bin_j, count(*) AS n FROM b f JOIN b r ON f.read = r.read AND NOT f.rev AND r.rev GROUP BY 1, 2), bins AS (SELECT DISTINCT bin, bin // 4 AS contig FROM b)"


def contacts(spark, sf):
    p = M.placements(spark, sf).select("read", "rev", F.expr("contig div 50").alias("bin"))
    m = B.contact_map(p)
    return m, p.select("bin").distinct().withColumn("contig", F.expr("bin div 4"))


@query("contact_map", f"WITH {SQL_MAP} SELECT * FROM map")
def contact_map(spark, sf):
    return contacts(spark, sf)[0]


@query("contact_map_scaled", f"""WITH {SQL_MAP}, r AS (SELECT contig // 200 AS contig, count(*) AS n, count(DISTINCT contig) AS length FROM placement GROUP BY 1), f AS (SELECT contig, n / sum(n) OVER () * length / sum(length) OVER () AS f FROM r),
 v AS (SELECT bin_i, bin_j, CASE WHEN a.contig = c.contig THEN n / f ELSE n END AS v FROM map JOIN bins a ON a.bin = bin_i JOIN bins c ON c.bin = bin_j JOIN f ON f.contig = a.contig) SELECT bin_i, bin_j, {s6('v / sum(v) OVER ()')} AS v FROM v""")
def contact_map_scaled(spark, sf):
    m, b = contacts(spark, sf)
    reads = M.placements(spark, sf).groupBy(F.expr("contig div 200").alias("contig")).agg(F.count("*").alias("n"), F.countDistinct("contig").alias("length"))
    return six(B.scaled_map(m, b, reads), "v")


@query("contact_block_map", f"WITH {SQL_MAP} SELECT least(a.contig, c.contig) AS ci, greatest(a.contig, c.contig) AS cj, {s6('avg(n)')} AS mean FROM map JOIN bins a ON a.bin = bin_i JOIN bins c ON c.bin = bin_j GROUP BY 1, 2")
def contact_block_map(spark, sf):
    return six(B.block_map(*contacts(spark, sf)), "mean")


@query("contig_contact_graph", f"WITH {SQL_MAP}, k AS (SELECT contig, count(*) AS nb, count(*) * 3 AS nf FROM bins GROUP BY 1), e AS (SELECT least(a.contig, c.contig) AS u, greatest(a.contig, c.contig) AS v, sum(n) AS n FROM map JOIN bins a ON a.bin = bin_i JOIN bins c ON c.bin = bin_j WHERE a.contig <> c.contig GROUP BY 1, 2) SELECT u, v, {s6('(n + x.nb * y.nb) / (x.nf * y.nf)')} AS weight FROM e JOIN k x ON x.contig = u JOIN k y ON y.contig = v")
def contig_contact_graph(spark, sf):
    m, b = contacts(spark, sf)
    frag = b.groupBy("contig").agg((F.count("*") * 3).alias("n_fragments"))
    return six(B.contig_graph(m, b, frag), "weight")
