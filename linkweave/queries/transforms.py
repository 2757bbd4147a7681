"""Matrix and edge transforms. The matrix is the heavy linkage graph with both arcs of each edge (all of it in the ``_all``
queries and in those without SQL), or the directed arcs."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import linkage as L, pack_matrices as PM, transforms as T
from linkweave.queries.linkage import edges, graph_query, heavy, packs
from linkweave.registry import query


def cells(spark, sf, graph=heavy):
    return T.mirrored(graph(spark, sf))


def arcs(spark, sf):
    return L.arcs(M.placements(spark, sf))


def rounded(df, *names):
    return df.withColumns({n: M.r6(n) for n in names or ("val",)})


def sql(body: str, base: str = M.SQL_CELL) -> str:
    return f"WITH {base}, out AS ({body}) SELECT col, row, {M.sql6('val')} AS val FROM out"


def arc_sql(body: str) -> str:
    return sql(body, f"{M.SQL_ARC}, b AS (SELECT a.col, a.row, a.val, coalesce(r.val, 0) AS back FROM arc a LEFT JOIN arc r ON a.col = r.row AND a.row = r.col)")


#: Dense on all edges: DuckDB takes too long there.
NO_WHOLE_SQL = {"matrix_step"}


def matrix(name: str, sql_text: str | None, of, source=cells):
    if source is arcs:
        query(name, sql_text)(lambda spark, sf: rounded(of(source(spark, sf))))
    elif sql_text is None:
        query(name)(lambda spark, sf: rounded(of(source(spark, sf, edges))))
    else:
        graph_query(name, sql_text, name not in NO_WHOLE_SQL)(lambda spark, sf, graph=heavy: rounded(of(source(spark, sf, graph))))


RANKED = "SELECT *, row_number() OVER (PARTITION BY col ORDER BY val DESC, row) AS k FROM cell"
COLSUM = "SELECT col, sum(val) AS s FROM cell GROUP BY col"

matrix("value_bounds", sql("SELECT * FROM cell WHERE val >= 2 AND val < 4"), lambda c: T.keep(c, gq=2, lt=4))
matrix("value_map_chain", sql("SELECT col, row, least(greatest(ln(val * 3 + 1) / ln(CAST(2 AS DOUBLE)), 3), 4) AS val FROM cell"), lambda c: T.Cells(c).mul(3).add(1).log(2).floor(3).ceil(4).df)
matrix("value_neglog", sql("SELECT col, row, -log10(val / 10) AS val FROM cell WHERE val <> 10"), lambda c: T.mapped(c, lambda v: -F.log10(v / 10)))
matrix("sym_max", sql("SELECT col, row, max(val) AS val FROM (SELECT * FROM arc UNION ALL SELECT row, col, val FROM arc) GROUP BY 1, 2", M.SQL_ARC), lambda c: T.symmetrised(c, "max"), arcs)
matrix("sym_add", sql("SELECT col, row, sum(val) AS val FROM (SELECT * FROM arc UNION ALL SELECT row, col, val FROM arc) GROUP BY 1, 2", M.SQL_ARC), lambda c: T.symmetrised(c, "add"), arcs)
matrix("sym_min", arc_sql("SELECT col, row, least(val, back) AS val FROM b WHERE back > 0"), lambda c: T.symmetrised(c, "min"), arcs)
matrix("sym_mul", arc_sql("SELECT col, row, val * back AS val FROM b WHERE back > 0"), lambda c: T.symmetrised(c, "mul"), arcs)
matrix("arc_max", arc_sql("SELECT * FROM b WHERE val >= back"), T.arc_max, arcs)
matrix("arc_max_bound", arc_sql("SELECT * FROM b WHERE val >= 2 OR back >= 2"), lambda c: T.arc_bound(c, "max", "gq", 2), arcs)
matrix("arc_min_bound", arc_sql("SELECT * FROM b WHERE val > 0 AND back > 0"), lambda c: T.arc_bound(c, "min", "gt", 0), arcs)
matrix("arc_diff_filter", arc_sql("SELECT * FROM b WHERE abs(val - back) < 1"), lambda c: T.arc_bound(c, "diff", "lt", 1), arcs)
matrix("arc_subtract", sql("SELECT col, row, sum(val) AS val FROM (SELECT * FROM arc UNION ALL SELECT row, col, -val FROM arc) GROUP BY 1, 2 HAVING sum(val) <> 0", M.SQL_ARC), T.arc_subtract, arcs)
matrix("transposed", sql("SELECT row AS col, col AS row, val FROM arc", M.SQL_ARC), T.transpose, arcs)
matrix("loops_max", sql("SELECT * FROM cell UNION ALL SELECT col, col, max(val) FROM cell GROUP BY col"), T.max_loops)
matrix("normed_by_self", sql("SELECT col, row, val / max(val) OVER (PARTITION BY col) AS val FROM cell"), T.norm_self)
matrix("mutual_knn", sql(f"WITH r AS ({RANKED}), t AS (SELECT * FROM r WHERE k <= 3) SELECT a.col, a.row, a.val FROM t a JOIN t b ON a.col = b.row AND a.row = b.col"), lambda c: T.mutual_knn(c, 3))
matrix("either_knn", sql(f"WITH r AS ({RANKED}), t AS (SELECT * FROM r WHERE k <= 2) SELECT col, row, max(val) AS val FROM (SELECT col, row, val FROM t UNION ALL SELECT row, col, val FROM t) GROUP BY 1, 2"), lambda c: T.either_knn(c, 2))
matrix("ceil_neighbours", None, lambda c: T.ceil_neighbours(c, 5), packs)
matrix("inverse_log_similarity", sql("WITH d AS (SELECT col, count(*) AS deg FROM cell GROUP BY col) SELECT a.row AS col, b.row AS row, sum(ln(CAST(2 AS DOUBLE)) / ln(CAST(deg AS DOUBLE))) AS val FROM cell a JOIN cell b ON a.col = b.col AND a.row <> b.row JOIN d ON d.col = a.col AND deg > 1 JOIN cell c ON c.col = a.row AND c.row = b.row GROUP BY 1, 2"), PM.inverse_log_similarity, packs)
matrix("ssq_filter", sql("SELECT col, row, val FROM (SELECT *, sum(val * val) OVER (PARTITION BY col) / sum(val) OVER (PARTITION BY col) AS bar FROM cell) WHERE val > CAST(0.95 AS DOUBLE) * bar"), lambda c: T.ssq_filter(c, 0.95))
matrix("quantile_filter", sql(f"SELECT col, row, val FROM (SELECT *, count(*) OVER (PARTITION BY col) AS n FROM ({RANKED})) WHERE k <= floor(CAST(0.4 AS DOUBLE) * n + CAST(0.5 AS DOUBLE))"), lambda c: T.quantile_filter(c, 0.4))
matrix("matrix_product", sql("SELECT a.col, b.row, sum(a.val * b.val) AS val FROM cell a JOIN cell b ON a.row = b.col GROUP BY 1, 2"), PM.squared, packs)
matrix("matrix_step", sql("WITH p AS (SELECT a.col, b.row, sum(a.val * b.val) AS val FROM cell a JOIN cell b ON a.row = b.col GROUP BY 1, 2) SELECT a.col, b.row, sum(a.val * b.val) AS val FROM p a JOIN p b ON a.row = b.col GROUP BY 1, 2"), PM.squared_twice, packs)
matrix("stochastic_columns", sql(f"SELECT col, row, val / s AS val FROM cell JOIN ({COLSUM}) USING (col)"), T.stochastic)
matrix("inflated_columns", sql("SELECT col, row, power(val, CAST(1.7 AS DOUBLE)) / sum(power(val, CAST(1.7 AS DOUBLE))) OVER (PARTITION BY col) AS val FROM cell"), lambda c: T.inflated(c, 1.7))
matrix("expand_inflate_step", sql("WITH m0 AS (SELECT col, row, val FROM cell UNION ALL SELECT col, col, max(val) FROM cell GROUP BY col), m AS (SELECT col, row, val / sum(val) OVER (PARTITION BY col) AS val FROM m0), p AS (SELECT a.col, b.row, sum(a.val * b.val) AS val FROM m a JOIN m b ON a.row = b.col GROUP BY 1, 2) SELECT col, row, val * val / sum(val * val) OVER (PARTITION BY col) AS val FROM p"), lambda c: PM.expanded_inflated(c, 2), packs)
matrix("folded_nodes", sql("SELECT col // 2 * 2 AS col, row // 2 * 2 AS row, max(val) AS val FROM cell WHERE col // 2 <> row // 2 GROUP BY 1, 2"), lambda c: T.folded(c, c.select(F.col("col").alias("node")).distinct().withColumn("master", F.expr("node div 2 * 2"))))
matrix("renamed_nodes", sql("SELECT col % 100 AS col, row % 100 AS row, sum(val) AS val FROM cell GROUP BY 1, 2"), lambda c: T.renamed(c, c.select(F.col("col").alias("old")).distinct().withColumn("new", F.col("old") % 100)))
matrix("ncut_weights", sql(f"WITH d AS ({COLSUM}) SELECT c.col, c.row, val / (a.s * b.s) AS val FROM cell c JOIN d a ON a.col = c.col JOIN d b ON b.col = c.row"), lambda c: T.ncut_weights(c, "product"))
matrix("ncut_weights_sqrt", sql(f"WITH d AS ({COLSUM}) SELECT c.col, c.row, val / sqrt(a.s * b.s) AS val FROM cell c JOIN d a ON a.col = c.col JOIN d b ON b.col = c.row"), lambda c: T.ncut_weights(c, "sqrt"))
matrix("top_k_ties", sql("SELECT col, row, val FROM (SELECT *, rank() OVER (PARTITION BY col ORDER BY val DESC) AS k FROM cell) WHERE k <= 3"), lambda c: T.top_k_ties(c, 3))
matrix("threshold_pruned", sql("WITH m AS (SELECT col, row, val / sum(val) OVER (PARTITION BY col) AS val FROM cell), s AS (SELECT *, avg(val) OVER (PARTITION BY col) AS a, max(val) OVER (PARTITION BY col) AS x FROM m) SELECT col, row, val FROM s WHERE val >= least(x, greatest(CAST(1e-7 AS DOUBLE), CAST(0.9 AS DOUBLE) * a * (1 - 2 * (x - a)))) - CAST(1e-12 AS DOUBLE)"), lambda c: T.threshold_pruned(T.stochastic(c)))
matrix("bibliographic_coupling", sql("SELECT a.col, b.col AS row, sum(a.val * b.val) AS val FROM cell a JOIN cell b ON a.row = b.row AND a.col <> b.col GROUP BY 1, 2 HAVING sum(a.val * b.val) >= 5"), lambda c: PM.co_citation(c, 5), packs)
matrix("upper_triangle", sql("SELECT * FROM cell WHERE col < row"), lambda c: c.filter("col < row"))
matrix("perturbed_values", sql("WITH n AS (SELECT col, sqrt(sum(val * val)) AS n FROM cell GROUP BY col), d AS (SELECT e.col, e.row, sum(a.val * b.val) AS dot FROM cell e JOIN cell a ON a.col = e.col JOIN cell b ON b.col = e.row AND b.row = a.row GROUP BY 1, 2) SELECT e.col, e.row, e.val * (1 + CAST(0.01 AS DOUBLE) * coalesce(dot, 0) / (x.n * y.n)) AS val FROM cell e LEFT JOIN d ON d.col = e.col AND d.row = e.row JOIN n x ON x.col = e.col JOIN n y ON y.col = e.row"), lambda c: T.perturbed(c, 0.01))


@graph_query("matrix_sum", f"WITH {M.SQL_CELL} SELECT col, row, sum(val) AS val FROM (SELECT * FROM cell UNION ALL SELECT * FROM arc) GROUP BY 1, 2")
def matrix_sum(spark, sf, graph=heavy):
    return T.combined(cells(spark, sf, graph), arcs(spark, sf), "add")


@graph_query("hadamard_product", f"WITH {M.SQL_CELL} SELECT c.col, c.row, c.val * a.val AS val FROM cell c JOIN arc a ON a.col = c.col AND a.row = c.row")
def hadamard_product(spark, sf, graph=heavy):
    return T.combined(cells(spark, sf, graph), arcs(spark, sf), "mul")


@graph_query("frobenius_change", f"WITH {M.SQL_CELL} SELECT {M.sql6('sqrt(sum(d * d))')} AS distance FROM (SELECT sum(val) AS d FROM (SELECT * FROM cell UNION ALL SELECT col, row, -val FROM arc) GROUP BY col, row)")
def frobenius_change(spark, sf, graph=heavy):
    return rounded(T.frobenius(cells(spark, sf, graph), arcs(spark, sf)), "distance")


@graph_query("flow_distance", f"WITH {M.SQL_CELL}, f AS (SELECT col, row, val / sum(val) OVER (PARTITION BY col) AS val FROM cell), n AS (SELECT col, sum(val * val) AS n FROM f GROUP BY col), d AS (SELECT e.col, e.row, sum(a.val * b.val) AS dot FROM cell e JOIN f a ON a.col = e.col JOIN f b ON b.col = e.row AND b.row = a.row GROUP BY 1, 2) SELECT e.col, e.row, {M.sql6('sqrt(greatest(x.n + y.n - 2 * coalesce(dot, 0), 0))')} AS distance FROM cell e LEFT JOIN d ON d.col = e.col AND d.row = e.row JOIN n x ON x.col = e.col JOIN n y ON y.col = e.row")
def flow_distance(spark, sf, graph=heavy):
    return rounded(PM.flow_distance(packs(spark, sf, graph)), "distance")


@graph_query("adjacency_lines", f"WITH {M.SQL_CELL} SELECT col, string_agg(CAST(row AS VARCHAR) || ':' || CAST(CAST(val AS BIGINT) AS VARCHAR), ' ' ORDER BY row) AS line FROM cell GROUP BY col")
def adjacency_lines(spark, sf, graph=heavy):
    from linkweave.sources.matrices import adjacency

    return adjacency(cells(spark, sf, graph))
