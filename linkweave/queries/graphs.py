"""Graph algorithms, clustering and similarity over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import communities, cover, forest, linkage as L, markov as K, pack_matrices as PM, paths as P, similarity as S, stars, transforms as T, variants as V
from linkweave.operators.packs import SEARCH_ARCS
from linkweave.queries.linkage import edges, graph_query, heavy, packs
from linkweave.registry import ORACLE, query


def cells(spark, sf, graph=heavy):
    return T.mirrored(graph(spark, sf))


def six(df, *names):
    return df.withColumns({n: M.r6(n) for n in names})


s6 = M.sql6
SQL_FULL = f"{M.SQL_EDGE}, cell AS (SELECT u AS col, v AS row, weight AS val FROM edge UNION ALL SELECT v, u, weight FROM edge)"
#: Each node's smallest label, told along edges until nothing changes.
SQL_WHOLE = f"""WITH RECURSIVE {SQL_FULL}, seed AS MATERIALIZED (SELECT DISTINCT 1 AS t, col AS node FROM cell), lab(node, comp) USING KEY (node) AS (SELECT node, node FROM seed UNION
 SELECT c.row, min(l.comp) FROM lab l JOIN cell c ON c.col = l.node JOIN recurring.lab r ON r.node = c.row WHERE l.comp < r.comp GROUP BY 1)"""
SQL_REACH = f"WITH RECURSIVE {M.SQL_CELL}, reach(node, root) AS (SELECT DISTINCT col, col FROM cell UNION SELECT c.row, r.root FROM reach r JOIN cell c ON c.col = r.node)"


@graph_query("connected_components", f"{SQL_REACH} SELECT p_partkey AS node, coalesce(m, p_partkey) AS component FROM part LEFT JOIN (SELECT node, min(root) AS m FROM reach GROUP BY 1) ON node = p_partkey", whole_sql=False)
def connected_components(spark, sf, graph=heavy):
    return P.components(M.nodes(spark, sf), cells(spark, sf, graph))


@graph_query("component_sizes", f"{SQL_REACH}, k AS (SELECT node, min(root) AS m FROM reach GROUP BY 1), n AS (SELECT m, count(*) AS size FROM k GROUP BY 1) SELECT size, count(*) AS components FROM n GROUP BY 1", whole_sql=False)
def component_sizes(spark, sf, graph=heavy):
    c = P.components(L.ends(graph(spark, sf)), cells(spark, sf, graph)).groupBy("component").agg(F.count("*").alias("size"))
    return c.groupBy("size").agg(F.count("*").alias("components"))


ORACLE["connected_components_all"] = f"{SQL_WHOLE} SELECT p_partkey AS node, coalesce(comp, p_partkey) AS component FROM part LEFT JOIN lab ON node = p_partkey"
ORACLE["component_sizes_all"] = f"{SQL_WHOLE}, n AS (SELECT comp, count(*) AS size FROM lab GROUP BY 1) SELECT size, count(*) AS components FROM n GROUP BY 1"

SQL_BFS = f"WITH RECURSIVE {M.SQL_CELL}, b(source, node, dist) AS (SELECT node, node, CAST(0 AS BIGINT) FROM (SELECT DISTINCT col AS node FROM cell ORDER BY 1 LIMIT 40) UNION SELECT b.source, c.row, b.dist + 1 FROM b JOIN cell c ON c.col = b.node WHERE b.dist < 12), d AS (SELECT source, node, min(dist) AS dist FROM b GROUP BY 1, 2)"


def sources(spark, sf):
    return cells(spark, sf).select(F.col("col").alias("node")).distinct().orderBy("node").limit(40)


@query("bfs_distance", f"{SQL_BFS} SELECT source, node, dist FROM d")
def bfs_distance(spark, sf):
    return P.distances(cells(spark, sf), sources(spark, sf), 12)


@query("eccentricity", f"{SQL_BFS} SELECT source AS node, max(dist) AS ecc FROM d GROUP BY 1")
def eccentricity(spark, sf):
    return P.eccentricity(P.distances(cells(spark, sf), sources(spark, sf), 12))


@query("bfs_distance_all")
def bfs_distance_all(spark, sf):
    return P.all_distances(packs(spark, sf, edges, pack_arcs=SEARCH_ARCS))


@query("eccentricity_all")
def eccentricity_all(spark, sf):
    return P.all_eccentricities(packs(spark, sf, edges, pack_arcs=SEARCH_ARCS))


@query("betweenness")
def betweenness(spark, sf):
    return six(P.all_betweenness(packs(spark, sf, edges, pack_arcs=SEARCH_ARCS)), "score")


@query("clustering_coefficient", f"WITH {SQL_FULL}, t AS (SELECT a.col AS node, count(*) AS t FROM cell a JOIN cell b ON a.col = b.col AND a.row < b.row JOIN cell c ON c.col = a.row AND c.row = b.row GROUP BY 1), d AS (SELECT col AS node, count(*) AS d FROM cell GROUP BY 1) SELECT p_partkey AS node, {s6('CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END')} AS coefficient FROM part LEFT JOIN d ON d.node = p_partkey LEFT JOIN t ON t.node = p_partkey")
def clustering_coefficient(spark, sf):
    return six(P.clustering_coefficient(M.nodes(spark, sf), T.mirrored(edges(spark, sf))), "coefficient")


@query("ils_full_graph", f"WITH {SQL_FULL}, d AS (SELECT col, count(*) AS deg FROM cell GROUP BY col) SELECT a.row AS col, b.row AS row, {s6('sum(ln(CAST(2 AS DOUBLE)) / ln(CAST(deg AS DOUBLE)))')} AS val FROM cell a JOIN cell b ON a.col = b.col AND a.row <> b.row JOIN d ON d.col = a.col AND deg > 1 JOIN cell c ON c.col = a.row AND c.row = b.row GROUP BY 1, 2")
def ils_full_graph(spark, sf):
    return six(PM.inverse_log_similarity(packs(spark, sf, edges)), "val")


@graph_query("neighbourhood", f"WITH {M.SQL_CELL}, s AS (SELECT p_partkey AS node FROM part WHERE p_size > 45), h AS (SELECT node FROM s UNION SELECT row FROM cell WHERE col IN (SELECT node FROM s)) SELECT node FROM h UNION SELECT row FROM cell WHERE col IN (SELECT node FROM h)")
def neighbourhood(spark, sf, graph=heavy):
    return P.neighbourhood(cells(spark, sf, graph), L.long_nodes(M.nodes(spark, sf), 45), 2)


@query("page_rank")
def page_rank(spark, sf):
    return six(P.page_rank(M.nodes(spark, sf), packs(spark, sf, edges)), "rank")


@query("markov_clusters")
def markov_clusters(spark, sf):
    return K.markov_clusters(packs(spark, sf, edges, K.pack_nodes(K.MOST)), M.nodes(spark, sf))


def rounds_of(spark, flow):
    return spark.createDataFrame(flow.rounds, "round long, chaos double, cells long, least_kept double, mean_kept double")


@query("markov_rounds")
def markov_rounds(spark, sf):
    """What each round of Markov clustering keeps of its columns."""
    return rounds_of(spark, K.markov_flow(packs(spark, sf, edges, K.pack_nodes(K.MOST))))


@query("regularised_clusters")
def regularised_clusters(spark, sf):
    p = packs(spark, sf, edges, K.pack_nodes(K.MOST))
    return K.attractor_of(K.regularised_flow(p, L.ends(edges(spark, sf))).cells)


@query("multilevel_clusters")
def multilevel_clusters(spark, sf):
    """Coarsened by matchings, then a few rounds on each level."""
    return K.multilevel_clusters(cells(spark, sf, edges), L.ends(edges(spark, sf)), per_level=2, rounds=4, max_levels=3)


@query("soft_clusters")
def soft_clusters(spark, sf):
    """Clusters of two runs of twelve rounds, pruned by density and overlap."""
    return K.soft_clusters(cells(spark, sf, edges), L.ends(edges(spark, sf)), times=2, rounds=12, density=0.01)


@query("clustered_cells")
def clustered_cells(spark, sf):
    return six(K.clustered_cells(L.arcs(M.placements(spark, sf)), both_ways=True), "val")


SQL_FLOW = f"{M.SQL_CELL}, g0 AS (SELECT * FROM cell UNION ALL SELECT DISTINCT col, col, CAST(1 AS DOUBLE) FROM cell), g AS (SELECT col, row, val / sum(val) OVER (PARTITION BY col) AS val FROM g0)"


@graph_query("balance_penalty", f"WITH {SQL_FLOW}, k AS (SELECT row, sum(val) AS k FROM g GROUP BY 1), s AS (SELECT col, g.row, val * CASE WHEN k > 1 THEN power(k, CAST(-0.5 AS DOUBLE)) ELSE 1 END AS val FROM g JOIN k ON k.row = g.row) SELECT col, row, {s6('val / sum(val) OVER (PARTITION BY col)')} AS val FROM s")
def balance_penalty(spark, sf, graph=heavy):
    g = T.stochastic(K.with_unit_loops(cells(spark, sf, graph), L.ends(graph(spark, sf))))
    return six(K.balanced(g, g, 0.5), "val")


@graph_query("regularised_step", f"WITH {SQL_FLOW}, p AS (SELECT a.col, b.row, sum(a.val * b.val) AS val FROM g a JOIN g b ON a.row = b.col GROUP BY 1, 2), i AS (SELECT col, row, val * val / sum(val * val) OVER (PARTITION BY col) AS val FROM p), s AS (SELECT *, avg(val) OVER (PARTITION BY col) AS a, max(val) OVER (PARTITION BY col) AS x FROM i), t AS (SELECT * FROM s WHERE val >= least(x, greatest(CAST(1e-7 AS DOUBLE), CAST(0.9 AS DOUBLE) * a * (1 - 2 * (x - a))))) SELECT col, row, {s6('val / sum(val) OVER (PARTITION BY col)')} AS val FROM t")
def regularised_step(spark, sf, graph=heavy):
    return six(PM.regularised_step(packs(spark, sf, graph), 2.0), "val")


@graph_query("heavy_edge_matching", f"WITH {M.SQL_CELL}, s AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY val * 2 DESC, row) AS k FROM cell), p AS (SELECT col, row FROM s WHERE k = 1) SELECT a.col AS node, a.row AS mate FROM p a JOIN p b ON a.col = b.row AND a.row = b.col")
def heavy_edge_matching(spark, sf, graph=heavy):
    return K.matching(cells(spark, sf, graph), L.ends(graph(spark, sf)).withColumn("weight", F.lit(1.0)), 1e9)


@query("merged_clusters")
def merged_clusters(spark, sf):
    part = M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))
    return K.merged_clusters(T.mirrored(edges(spark, sf)), part, 3)


SQL_OWN = f"{M.SQL_CELL}, own AS (SELECT col, count(*) AS d, avg(val) AS m FROM cell GROUP BY 1)"


@graph_query("star_relevance", f"WITH {SQL_OWN} SELECT c.col AS node, {s6('0.5 * (count(*) FILTER (b.d <= a.d) + count(*) FILTER (a.m >= b.m)) / any_value(a.d)')} AS relevance FROM cell c JOIN own a ON a.col = c.col JOIN own b ON b.col = c.row GROUP BY 1")
def star_relevance(spark, sf, graph=heavy):
    return six(cover.relevance(cells(spark, sf, graph)), "relevance")


SQL_CUTS = f"{M.SQL_CELL}, c AS (SELECT col, row, val, a.p_brand AS c1, b.p_brand AS c2 FROM cell JOIN part a ON a.p_partkey = col JOIN part b ON b.p_partkey = row WHERE a.p_brand <> b.p_brand)"


@graph_query("soft_communities", f"WITH {SQL_CUTS} SELECT p_brand AS cluster, p_partkey AS node, CAST(1 AS DOUBLE) AS w FROM part UNION ALL SELECT DISTINCT c2, col, CAST(0.5 AS DOUBLE) FROM c")
def soft_communities(spark, sf, graph=heavy):
    part = M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))
    return cover.soft_partition(cells(spark, sf, graph), part)


@graph_query("soft_communities_maxaff", f"WITH {SQL_CUTS}, m AS (SELECT *, max(val) OVER (PARTITION BY col) AS most FROM c) SELECT p_brand AS cluster, p_partkey AS node, CAST(1 AS DOUBLE) AS w FROM part UNION ALL SELECT DISTINCT c2, col, CAST(0.5 AS DOUBLE) FROM m WHERE val = most")
def soft_communities_maxaff(spark, sf, graph=heavy):
    part = M.hard_clusters(spark, sf).select("cluster", F.col("obj").alias("node"))
    return cover.soft_partition(cells(spark, sf, graph), part, "maxaff")


def vectors(spark, sf):
    return M.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


SQL_VEC = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SQL_SIM = "SELECT a.id AS a, b.id AS b, {0} AS s FROM x a JOIN x b ON a.id < b.id"


@query("cosine_pairs", f"WITH {SQL_VEC}, x AS (SELECT * FROM e), p AS ({SQL_SIM.format('list_cosine_similarity(a.v, b.v)')}) SELECT a, b, {s6('s')} AS s FROM p WHERE abs(s) >= CAST(0.35 AS DOUBLE)")
def cosine_pairs(spark, sf):
    return six(S.cosine(vectors(spark, sf), 0.35), "s")


@query("inner_product_pairs", f"WITH {SQL_VEC}, x AS (SELECT * FROM e), p AS ({SQL_SIM.format('list_dot_product(a.v, b.v)')}) SELECT a, b, {s6('s')} AS s FROM p WHERE abs(s) >= CAST(0.4 AS DOUBLE)")
def inner_product_pairs(spark, sf):
    return six(S.inner(vectors(spark, sf), 0.4), "s")


@query("pearson_pairs", f"WITH {SQL_VEC}, x AS (SELECT id, list_transform(v, lambda y: y - list_avg(v)) AS v FROM e), p AS ({SQL_SIM.format('list_cosine_similarity(a.v, b.v)')}) SELECT a, b, {s6('s')} AS s FROM p WHERE abs(s) >= CAST(0.35 AS DOUBLE)")
def pearson_pairs(spark, sf):
    return six(S.pearson(vectors(spark, sf), 0.35), "s")


@query("spearman_pairs", f"WITH {SQL_VEC}, u AS (SELECT id, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM e), r AS (SELECT id, i, rank() OVER (PARTITION BY id ORDER BY y) + (count(*) OVER (PARTITION BY id, y) - 1) / 2 AS k FROM u), x AS (SELECT id, list(k - CAST(32.5 AS DOUBLE) ORDER BY i) AS v FROM r GROUP BY id), p AS ({SQL_SIM.format('list_cosine_similarity(a.v, b.v)')}) SELECT a, b, {s6('s')} AS s FROM p WHERE abs(s) >= CAST(0.3515 AS DOUBLE)")
def spearman_pairs(spark, sf):
    return six(S.spearman(vectors(spark, sf), 0.3515), "s")


SQL_SET = "i AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem WHERE l_quantity >= 40), n AS (SELECT id, count(*) AS n FROM i GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM i a JOIN i b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2), q AS (SELECT p.*, x.n AS na, y.n AS nb FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)"


SQL_SET_ALL = SQL_SET.replace(" WHERE l_quantity >= 40", "")


def item_sets(spark, sf, which="l_quantity >= 40"):
    return M.table(spark, sf, "lineitem").filter(which).select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))


@query("tanimoto_pairs", f"WITH {SQL_SET} SELECT a, b, {s6('common / (na + nb - common)')} AS tanimoto, {s6('common / sqrt(na * nb)')} AS cosine, common AS meet, {s6('common / least(na, nb)')} AS cover, na + nb - 2 * common AS hamming FROM q")
def tanimoto_pairs(spark, sf):
    return six(S.set_scores(S.set_pairs(item_sets(spark, sf))), "tanimoto", "cosine", "cover")


@query("subset_fraction", f"WITH {SQL_SET} SELECT a, b, {s6('common / na')} AS meet, {s6('1 - common / na')} AS diff FROM q UNION ALL SELECT b, a, {s6('common / nb')}, {s6('1 - common / nb')} FROM q")
def subset_fraction(spark, sf):
    return six(S.subset_fractions(S.set_pairs(item_sets(spark, sf))), "meet", "diff")


SQL_TANIMOTO, SQL_SUBSET = (ORACLE[n].replace(SQL_SET, SQL_SET_ALL) for n in ("tanimoto_pairs", "subset_fraction"))


@query("tanimoto_pairs_all", SQL_TANIMOTO)
def tanimoto_pairs_all(spark, sf):
    return six(S.set_scores(S.set_pairs(item_sets(spark, sf, "true"))), "tanimoto", "cosine", "cover")


@query("subset_fraction_all", SQL_SUBSET)
def subset_fraction_all(spark, sf):
    return six(S.subset_fractions(S.set_pairs(item_sets(spark, sf, "true"))), "meet", "diff")


@query("snp_links", "WITH s AS (SELECT l_orderkey AS fragment, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS e, l_suppkey AS site FROM lineitem), p AS (SELECT least(a.site, b.site) AS s1, greatest(a.site, b.site) AS s2 FROM s a JOIN s b ON a.fragment = b.fragment AND a.e = 1 AND b.e = 2 AND a.site <> b.site) SELECT s1, s2, count(*) AS n FROM p GROUP BY 1, 2")
def snp_links(spark, sf):
    return V.site_links(seen_sites(spark, sf))


def seen_sites(spark, sf):
    return M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fragment"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).alias("end"), F.col("l_suppkey").alias("site"))


@query("snp_links_four_way", f"WITH s AS (SELECT l_orderkey AS fragment, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS e, l_suppkey AS site FROM lineitem), p AS (SELECT least(a.site, b.site) AS s1, greatest(a.site, b.site) AS s2, count(*) AS n FROM s a JOIN s b ON a.fragment = b.fragment AND a.e = 1 AND b.e = 2 AND a.site <> b.site GROUP BY 1, 2), r AS (SELECT l_suppkey AS site, count(*) FILTER (l_returnflag = 'R') / count(*) AS ratio FROM lineitem GROUP BY 1), k(a, b) AS (VALUES ('ref', 'ref'), ('ref', 'var'), ('var', 'ref'), ('var', 'var')) SELECT CAST(s1 AS VARCHAR) || '.' || a AS n1, CAST(s2 AS VARCHAR) || '.' || b AS n2, {s6('n * CASE a WHEN $$ref$$ THEN 1 - x.ratio ELSE x.ratio END * CASE b WHEN $$ref$$ THEN 1 - y.ratio ELSE y.ratio END')} AS weight FROM p JOIN r x ON x.site = s1 JOIN r y ON y.site = s2, k")
def snp_links_four_way(spark, sf):
    reads = M.table(spark, sf, "lineitem").select(F.lit(0).alias("contig"), F.col("l_suppkey").alias("site"), (F.col("l_returnflag") == "R").alias("is_var"))
    return six(V.four_way(V.site_links(seen_sites(spark, sf)), V.allele_ratio(reads)), "weight")


@query("culled_intervals", "WITH i AS (SELECT event_id AS id, user_id AS contig, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS start, value AS score FROM events), w AS (SELECT *, start + CAST(floor(score) AS BIGINT) * 300 AS stop FROM i) SELECT id, contig, start, stop, score FROM w a WHERE (SELECT count(*) FROM w b WHERE b.contig = a.contig AND b.start <= a.start AND a.stop <= b.stop AND b.score > a.score) < 1")
def culled_intervals(spark, sf):
    e = M.table(spark, sf, "events")
    pos = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).cast("long")
    i = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("contig"), pos.alias("start"), (pos + F.floor("value") * 300).alias("stop"), F.col("value").alias("score"))
    return S.culled(i, 1, 5_000)


@query("star_cover")
def star_cover(spark, sf):
    return stars.star_cover(cells(spark, sf, edges))


@query("louvain_communities")
def louvain_communities(spark, sf):
    return communities.communities(cells(spark, sf, edges))


@query("max_flows")
def max_flows(spark, sf):
    from linkweave.operators import local

    return local.by_component(cells(spark, sf), local.pair_flows, "u long, v long, flow double")


@query("spanning_forest")
def spanning_forest(spark, sf):
    return forest.spanning_forest(edges(spark, sf))


@query("spanning_order")
def spanning_order(spark, sf):
    return forest.spanning_order(edges(spark, sf))


#: Keyed recursion: each node's smallest label at each threshold, told along edges until nothing changes.
SQL_LABELS = """lab(t, node, comp) USING KEY (t, node) AS (SELECT t, node, node FROM seed UNION SELECT l.t, c.row, min(l.comp) FROM lab l JOIN cell c ON c.col = l.node AND c.val >= l.t
 JOIN recurring.lab r ON r.t = l.t AND r.node = c.row WHERE l.comp < r.comp GROUP BY 1, 2)"""
THRESHOLDS = [1, 2, 3, 4, 5]
SQL_SEED = f"WITH RECURSIVE {SQL_FULL}, k(t) AS (SELECT unnest({{0}})), seed AS MATERIALIZED (SELECT t, p_partkey AS node FROM part, k), {SQL_LABELS}"


@query("threshold_sweep", f"""{SQL_SEED.format(THRESHOLDS)}, size AS (SELECT t, comp, count(*) AS s FROM lab GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM part),
 c AS (SELECT t, 100 * max(s) / any_value(n) AS largest, 100 * coalesce(sum(s) FILTER (s <= 3), 0) / any_value(n) AS minor, 100 * coalesce(sum(s) FILTER (s = 1), 0) / any_value(n) AS single, sum(s * s) / any_value(n) AS cce FROM size, n GROUP BY t),
 w AS (SELECT t, count(weight) AS edges, avg(weight) AS ew_mean, quantile_cont(weight, 0.5) AS ew_med, quantile_cont(weight, 0.75) - quantile_cont(weight, 0.25) AS ew_iqr FROM k LEFT JOIN edge ON weight >= t GROUP BY t),
 d0 AS (SELECT t, node, count(val) AS d FROM seed LEFT JOIN cell ON col = node AND val >= t GROUP BY 1, 2),
 d AS (SELECT t, avg(d) AS nd_mean, quantile_cont(d, 0.5) AS nd_med, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS nd_iqr FROM d0 GROUP BY t)
 SELECT CAST(t AS DOUBLE) AS cutoff, edges, {", ".join(f"{s6(x)} AS {x.split('.')[-1]}" for x in ("largest", "minor", "single", "cce", "ew_mean", "ew_med", "ew_iqr", "nd_mean", "nd_med", "nd_iqr"))}, {s6("100 - largest - minor")} AS rest FROM c JOIN w USING (t) JOIN d USING (t)""")
def threshold_sweep(spark, sf):
    sweep = forest.threshold_sweep(edges(spark, sf), M.nodes(spark, sf), THRESHOLDS)
    return six(sweep, *[c for c in sweep.columns if c not in ("cutoff", "edges")])


@query("noisy_graph")
def noisy_graph(spark, sf):
    from linkweave.operators.generators import noise_edges

    return noise_edges(M.nodes(spark, sf), edges(spark, sf), 0.2, 7)


@query("shuffled_graph")
def shuffled_graph(spark, sf):
    from linkweave.operators.generators import shuffled

    return shuffled(edges(spark, sf), 3, 7)


@query("mutated_truth")
def mutated_truth(spark, sf):
    from linkweave.operators.generators import mutated

    return mutated(M.hard_truth(spark, sf), 0.1, 0.05, 7)
