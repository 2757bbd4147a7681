"""Iterative and order-dependent operators against brute force on small graphs, and identities of transforms and metrics."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.operators import cover, generators, linkage, local, markov, metrics, paths, similarity, transforms as T
from linkweave.operators.components import connected_components
from linkweave.sources import matrices
from tests.conftest import rows_of

BLOCKS_1 = [(1, 2, 3, 4, 5), (5, 6, 7, 8)]


def graph(spark, edges):
    return T.mirrored(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "u long, v long, weight double"))


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, 1) for i in ids], "node long, length int")


def random_edges(n, p, seed):
    rng = random.Random(seed)
    return [(a, b, rng.randint(1, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def bfs(edges, s):
    adj = {}
    for a, b, _ in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    dist, todo = {s: 0}, [s]
    for v in todo:
        for u in adj.get(v, ()):
            if u not in dist:
                dist[u] = dist[v] + 1
                todo.append(u)
    return dist


def test_components_and_distances(spark):
    edges = random_edges(30, 0.06, 1)
    cells = graph(spark, edges)
    want = {v: min(bfs(edges, v)) for v in range(30)}
    got = {r["node"]: r["component"] for r in paths.components(nodes_of(spark, range(30)), cells).collect()}
    assert got == want
    dist = paths.distances(cells, nodes_of(spark, [0, 3, 7]))
    assert {(r["source"], r["node"]): r["dist"] for r in dist.collect()} == {(s, v): d for s in (0, 3, 7) for v, d in bfs(edges, s).items()}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in connected_components(e).collect()} == {0}
    assert connected_components(e.limit(0)).count() == 0


def test_betweenness(spark):
    edges = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 1)]
    got = {r["node"]: r["score"] for r in paths.betweenness(graph(spark, edges), nodes_of(spark, range(5))).collect()}
    want = dict.fromkeys(range(5), 0.0)
    for s, t in itertools.permutations(range(5), 2):
        ds, dt = bfs(edges, s), bfs(edges, t)
        on = [v for v in range(5) if ds[v] + dt[v] == ds[t]]
        count = lambda a, b: 1 if a == b else sum(count(a, v) for v in range(5) if v in bfs(edges, b) and bfs(edges, b)[v] == 1 and bfs(edges, a)[v] == bfs(edges, a)[b] - 1)  # noqa: E731, B023
        for v in on:
            if v not in (s, t):
                want[v] += count(s, v) * count(v, t) / count(s, t)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(want[k], 9) for k in got}


def test_shortest_path_nodes(spark):
    edges = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1), (5, 6, 1)]
    assert {(r["node"], r["step"]) for r in paths.on_shortest_paths(graph(spark, edges), 0, 4).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert paths.on_shortest_paths(graph(spark, edges), 0, 5).count() == 0


def blocks(groups):
    return sorted({tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)})


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["node"])
    return {frozenset(v) for v in out.values()}


def test_markov_clustering_separates_cliques(spark):
    groups = [range(0, 6), range(6, 12), range(12, 17)]
    edges = [(a, b, 1) for a, b in blocks(groups)] + [(5, 6, 0.2), (11, 12, 0.2)]
    cells, nodes = graph(spark, edges), nodes_of(spark, range(18))
    want = {frozenset(g) for g in groups} | {frozenset([17])}
    assert clusters(markov.markov_clusters(cells, nodes, rounds=8)) == want
    assert clusters(markov.attractor_of(markov.regularised_flow(cells, nodes, rounds=5).cells)) == want


def test_columns_sum_to_one(spark):
    cells = graph(spark, random_edges(20, 0.3, 4))
    for df in (T.stochastic(cells), T.inflated(cells, 2.0), markov.pruned(T.stochastic(cells), 0.05, 3)):
        assert all(abs(r["s"] - 1) < 1e-9 for r in df.groupBy("col").agg(F.sum("val").alias("s")).collect())


def test_soft_clusters_of_overlapping_blocks(spark):
    edges = [(a, b, 1) for a, b in blocks(BLOCKS_1)]
    cells, nodes = graph(spark, edges), nodes_of(spark, range(1, 9))
    got = clusters(markov.soft_clusters(cells, nodes, times=2, rounds=3, density=0.5))
    assert got and all(any(g <= set(b) for b in BLOCKS_1) or len(g) > 3 for g in got)
    assert set().union(*got) == set(range(1, 9))


def test_multilevel_on_a_planted_partition(spark):
    e = generators.planted_partition(spark, 60, 4, 0.8, 0.02, 3)
    cells, nodes = T.mirrored(e), nodes_of(spark, range(60))
    got = markov.multilevel_clusters(cells, nodes, coarsest=35, per_level=2, rounds=4, max_levels=1)
    truth = nodes.select(F.col("node").alias("obj"), (F.col("node") % 4).alias("class"))
    tab = metrics.contingency(truth, got.select(F.col("node").alias("obj"), "cluster"), "class", "cluster")
    assert metrics.nmi(tab, "class", "cluster").first()["nmi"] > 0.6


def test_pair_flows(spark):
    groups = [range(0, 5), range(5, 10)]
    cells = graph(spark, [(a, b, 1) for a, b in blocks(groups)] + [(4, 5, 0.5)])
    flows = {(r["u"], r["v"]): r["flow"] for r in local.by_component(cells, local.pair_flows, "u long, v long, flow double").collect()}
    assert flows[0, 9] == 0.5 and flows[0, 1] == 4.0


def test_ceil_neighbours_matches_hub_by_hub(spark):
    edges = random_edges(9, 0.7, 9)
    w = {}
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    cells = graph(spark, edges)
    order = sorted(range(9), key=lambda v: (-sum(1 for a, _ in w if a == v), v))
    left = dict(w)
    for v in order:
        mine = sorted(((x, -b) for (a, b), x in left.items() if a == v), reverse=True)
        for x, b in mine[4:]:
            left.pop((v, -b))
            left.pop((-b, v))
    assert {(r["col"], r["row"]) for r in T.ceil_neighbours(cells, 4).collect()} == set(left)


@pytest.mark.parametrize("how", ["max", "add", "min", "mul"])
def test_symmetrising_gives_symmetric(spark, how):
    arcs = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0), (1, 3, 2.0), (4, 4, 5.0)], "col long, row long, val double")
    s = T.symmetrised(arcs, how)
    assert rows_of(s) == rows_of(T.transpose(s).select("col", "row", "val"))
    assert rows_of(T.transpose(T.transpose(arcs)).select("col", "row", "val")) == rows_of(arcs)


def test_metrics_of_equal_clusterings(spark):
    a = spark.createDataFrame([(i, i % 4) for i in range(40)], "obj long, class long")
    b = a.withColumnRenamed("class", "cluster")
    tab = metrics.contingency(a, b, "class", "cluster")
    assert metrics.bcubed_hard(tab, "class", "cluster").first()["f"] == 1
    assert metrics.v_measure(tab, "class", "cluster").first()["v"] == 1
    assert tuple(metrics.split_join(tab, "class", "cluster").first()) == (0, 0)
    assert tuple(metrics.mirkin(tab, "class", "cluster").first()) == (0, 0)
    assert metrics.matched_f1(tab, "class", "cluster").first()["f1"] == 1
    assert abs(metrics.fowlkes_mallows(a.withColumn("support", F.lit(1.0)), b).first()["gfm"] - 1) < 1e-12
    soft = metrics.bcubed_soft(a, b).first()
    assert soft["pre"] == soft["rec"] == soft["completeness"] == 1


def test_soft_bcubed_matches_pairs(spark):
    rng = random.Random(2)
    t = {o: set(rng.sample(range(70), rng.randint(1, 3))) for o in range(25)}
    c = {o: set(rng.sample(range(4), rng.randint(1, 2))) for o in range(25)}
    df = lambda m, k: spark.createDataFrame([(o, x) for o, v in m.items() for x in v], f"obj long, {k} long")
    mean = lambda x: sum(x) / len(x)
    score = lambda own, other: mean([mean([min(len(own[a] & own[b]), len(other[a] & other[b])) / len(own[a] & own[b]) for b in own if own[a] & own[b]]) for a in own])
    got = metrics.bcubed_soft(df(t, "class"), df(c, "cluster")).first()
    assert abs(got["pre"] - score(c, t)) < 1e-12 and abs(got["rec"] - score(t, c)) < 1e-12


def test_hungarian_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.integers(0, 20, (5, 5)).astype(float)
        best = min(sum(m[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        assert sum(m[i, j] for i, j in enumerate(metrics.hungarian(m))) == best


def test_linkage_counts_match_enumeration(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(6), rng.random() < 0.5, 30.0) for _ in range(60)]
    placed = spark.createDataFrame(rows, "read long, contig long, rev boolean, mapq double")
    want, every = {}, {}
    for (r1, c1, d1, _), (r2, c2, d2, _) in itertools.combinations(rows, 2):
        if r1 == r2:
            k = (min(c1, c2), max(c1, c2))
            every[k] = every.get(k, 0) + 1
            if d1 != d2 and c1 != c2:
                want[k] = want.get(k, 0) + 1
    assert {(r["u"], r["v"]): r["weight"] for r in linkage.linkage(placed).collect()} == want
    assert {(r["u"], r["v"]): r["weight"] for r in linkage.linkage_all_pairs(placed).collect()} == every
    assert linkage.linkage(placed.limit(0)).count() == 0


def test_soft_partition_and_residue(spark):
    cells = graph(spark, [(1, 2, 1), (2, 3, 2), (3, 4, 1)])
    part = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "cluster long, node long")
    got = {(r["cluster"], r["node"], r["w"]) for r in cover.soft_partition(cells, part).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (2, 4, 1.0), (2, 2, 0.5), (1, 3, 0.5)}
    assert {(r["node"], r["cluster"]) for r in cover.residue(cells, part).collect()} == {(1, 1), (2, 2), (3, 1), (4, 2)}


def test_generators(spark):
    nodes = nodes_of(spark, range(50)).withColumn("length", F.col("node") + 1)
    edges = spark.createDataFrame([(0, 1, 100.0)], "u long, v long, weight double")
    noisy = generators.noise_edges(nodes, edges, 0.5, 3)
    assert rows_of(noisy) == rows_of(generators.noise_edges(nodes, edges, 0.5, 3))
    extra = noisy.agg(F.sum("weight")).first()[0] - 100
    assert 40 <= extra <= 50 and noisy.filter("u >= v").count() == 0
    truth = spark.createDataFrame([(i, f"c{i % 3}") for i in range(600)], "obj long, class string")
    out = generators.mutated(truth, 0.2, 0.1, 1)
    both = out.join(truth.withColumnRenamed("class", "was"), "obj")
    assert 500 < out.count() < 580 and 70 < both.filter("class <> was").count() < 150


def write(tmp_path, text):
    p = tmp_path / "in.txt"
    p.write_text(text)
    return str(p)


def test_text_sources(spark, tmp_path):
    at = write(tmp_path, "# c\na b 2\na\tb x\t3\n\nc d\n")
    got = {tuple(r) for r in matrices.abc(matrices.lines(spark, at)).collect()}
    assert got == {("a", "b", 2.0), ("a", "b x", 3.0), ("c", "d", 1.0)}
    at = write(tmp_path, "a b:2 c\nb d:0.5\n")
    assert {tuple(r) for r in matrices.etc(matrices.lines(spark, at)).collect()} == {("a", "b", 2.0), ("a", "c", 1.0), ("b", "d", 0.5)}
    at = write(tmp_path, "a rel b c\n")
    assert {tuple(r) for r in matrices.sif(matrices.lines(spark, at)).collect()} == {("a", "b", 1.0), ("a", "c", 1.0)}
    at = write(tmp_path, "3 2 1\n2 10\n1 10 3 5\n2 5\n")
    assert {tuple(r) for r in matrices.metis(matrices.numbered_lines(spark, at)).collect()} == {(1, 2, 10.0), (2, 1, 10.0), (2, 3, 5.0), (3, 2, 5.0)}
    at = write(tmp_path, "b a\nc\n")
    member = matrices.cluster_lines(matrices.numbered_lines(spark, at))
    assert {(r["cluster"], r["line"]) for r in matrices.written_clusters(member).collect()} == {(0, "a b"), (1, "c")}
    tab = spark.createDataFrame([(0, "a"), (1, "b")], "id long, label string")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "z", 1.0)], "a string, b string, w double")
    assert matrices.labelled(pairs, tab).count() == 1
    with pytest.raises(ValueError):
        matrices.labelled(pairs, tab, "strict")
    assert {tuple(r) for r in matrices.merged(pairs.unionByName(pairs), "add").collect()} == {("a", "b", 2.0), ("a", "z", 2.0)}


@pytest.mark.parametrize("listed", [32, 3, 0])
def test_set_pairs_of_small_and_large_sets(spark, monkeypatch, listed):
    monkeypatch.setattr(similarity, "LISTED", listed)
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(12), rng.randint(1, 6))) for i in range(20)}
    items = [(i, x) for i in sets for x in [*sets[i], *sets[i]]] + [(0, None)]
    got = {(r["a"], r["b"]): (r["common"], r["na"], r["nb"]) for r in similarity.set_pairs(spark.createDataFrame(items, "id long, item long")).collect()}
    size = {i: len(sets[i]) + (i == 0) for i in sets}
    assert got == {(a, b): (len(sets[a] & sets[b]), size[a], size[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_pairs_are_not_shuffled(spark):
    items = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "id long, item long")
    assert similarity.set_pairs(items)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(a#") == 0
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    assert "Exchange" not in similarity.cosine(rows, 0.5)._jdf.queryExecution().executedPlan().toString()
