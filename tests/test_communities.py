"""Louvain, star cover, spanning forest and sweep, each against a walk over a small graph node by node."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkweave.operators import communities, forest, stars, transforms as T
from linkweave.operators.cover import relevance
from tests.test_graphs import graph, nodes_of, random_edges

PATH = [(i, i + 1, 1) for i in range(30)]
CLIQUES = [(10 * c + a, 10 * c + b, 2) for c in range(5) for a, b in itertools.combinations(range(10), 2)] + [(10 * c, (10 * c + 10) % 50, 1) for c in range(5)]
TWO = random_edges(25, 0.2, 9) + [(100 + a, 100 + b, w) for a, b, w in random_edges(12, 0.4, 2)]


def adjacency(edges):
    adj = defaultdict(dict)
    for a, b, w in edges:
        adj[a][b] = adj[b][a] = w
    return adj


def modularity(adj, home):
    total = sum(sum(n.values()) for n in adj.values())
    inside, mass = 0, defaultdict(float)
    for v, n in adj.items():
        mass[home[v]] += sum(n.values())
        inside += sum(w for u, w in n.items() if home[u] == home[v])
    return inside / total - sum((m / total) ** 2 for m in mass.values())


def one_by_one(adj):
    """Modularity that moves node by node, with contraction, reach."""
    groups = {v: {v} for v in adj}
    home = {v: v for v in adj}
    while True:
        names, any_move, moved = sorted(groups), False, True
        at = {g: g for g in names}
        weight = {g: sum(sum(adj[v].values()) for v in groups[g]) for g in names}
        mass, total = dict(weight), sum(weight.values())
        of = {v: g for g in names for v in groups[g]}
        near = {g: defaultdict(float) for g in names}
        for g in names:
            for v in groups[g]:
                for u, w in adj[v].items():
                    if of[u] != g:
                        near[g][of[u]] += w
        while moved:
            moved = False
            for g in names:
                k = defaultdict(float)
                for h, w in near[g].items():
                    k[at[h]] += w
                gain = lambda c: k[c] - weight[g] * (mass[c] - (weight[g] if c == at[g] else 0)) / total  # noqa: E731, B023
                best = max(sorted({*k, at[g]}), key=gain)
                if gain(best) > gain(at[g]) + 1e-12:
                    mass[at[g]] -= weight[g]
                    mass[best] += weight[g]
                    at[g], moved, any_move = best, True, True
        new = defaultdict(set)
        for g in names:
            new[at[g]] |= groups[g]
        groups = dict(new)
        if not any_move:
            return modularity(adj, {v: g for g in groups for v in groups[g]} or home)


@pytest.mark.parametrize("edges", [CLIQUES, TWO, PATH], ids=["cliques", "two", "path"])
def test_louvain_is_near_one_by_one_and_never_falls(spark, edges):
    found, kept = communities.louvain(graph(spark, edges))
    home = {r["node"]: r["cluster"] for r in found.collect()}
    adj = adjacency(edges)
    assert set(home) == set(adj)
    assert all(c == min(v for v in home if home[v] == c) for c in home.values())
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(kept))
    assert kept[-1] == pytest.approx(modularity(adj, home), abs=1e-9)
    assert modularity(adj, home) >= 0.98 * one_by_one(adj)


def test_louvain_without_arcs_and_with_isolates(spark):
    none = graph(spark, PATH).limit(0)
    assert communities.louvain(none)[0].collect() == []
    got = communities.communities(graph(spark, [(1, 2, 1)]), nodes_of(spark, [1, 2, 7, 9]), ragbag=True).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (7, 7), (7, 9)]
    got = communities.communities(graph(spark, [(1, 2, 1), (3, 3, 5)]), nodes_of(spark, [1, 2, 3, 9])).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (3, 3), (9, 9)]


def walked_cover(cells, edges):
    adj = adjacency(edges)
    key = {r["node"]: (r["h"], r["node"]) for r in cells.select(F.col("col").alias("node")).distinct().withColumn("h", F.xxhash64("node")).collect()}
    rel = {r["node"]: r["relevance"] for r in relevance(cells).collect()}
    hubs, covered = [], set()
    for v in sorted(adj, key=lambda x: (-rel[x], key[x])):
        if not {v, *adj[v]} <= covered:
            hubs.append(v)
            covered |= {v, *adj[v]}
    alive, judged, linked = set(hubs), set(), defaultdict(set)
    turn = lambda some: sorted(some, key=lambda x: (-len(adj[x]), key[x]))
    for h in turn(hubs):
        if h in alive:
            for u in turn(x for x in adj[h] if x in alive and x not in judged):
                judged.add(u)
                shared = {s for s in adj[u] if any(w in alive and w != u for w in adj[s]) or s in alive and len(adj[s]) > 1}
                if 2 * len(shared) > len(adj[u]):
                    alive.discard(u)
                    linked[h] |= set(adj[u]) - shared | linked.pop(u, set())
    return {(h, s) for h in alive for s in {h, *adj[h], *linked[h]}}


@pytest.mark.parametrize("edges", [TWO, PATH, random_edges(40, 0.06, 2), random_edges(40, 0.3, 4)])
def test_star_cover_is_the_walk(spark, edges):
    cells = T.cut(graph(spark, edges))
    assert {(r["cluster"], r["node"]) for r in stars.star_cover(cells).collect()} == walked_cover(cells, edges)


def kruskal(edges):
    root, out = {}, []
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for w, a, b in sorted(((-w, min(a, b), max(a, b)) for a, b, w in edges)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, -w))
    return sorted(out)


@pytest.mark.parametrize("edges", [TWO, PATH, random_edges(60, 0.05, 8)], ids=["two", "path", "sparse"])
def test_forest_and_walk(spark, edges):
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "u long, v long, weight double")
    tree = kruskal(edges)
    assert sorted(map(tuple, forest.spanning_forest(e).collect())) == tree
    adj, want = adjacency(tree), {}
    for start in sorted(adj):
        if start not in want:
            stack, place = [(start, None)], 0
            while stack:
                v, parent = stack.pop()
                want[v] = (start, parent, place)
                place += 1
                stack += [(u, v) for u in sorted(adj[v], key=lambda x: (-adj[v][x], x), reverse=True) if u != parent]
    assert {r["node"]: (r["component"], r["parent"], r["place"]) for r in forest.spanning_order(e).collect()} == want
    assert forest.spanning_order(e.limit(0)).collect() == []


def test_sweep_of_light_and_no_edges(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (4, 5, 3.0)], "u long, v long, weight double")
    got = {r["cutoff"]: r for r in forest.threshold_sweep(e, nodes_of(spark, range(1, 8)), [1, 2, 9]).collect()}
    assert [got[t]["cce"] for t in (1, 2, 9)] == [15 / 7, 11 / 7, 1.0]
    assert got[1]["largest"] == 300 / 7 and got[9]["single"] == 100.0 and got[9]["ew_mean"] is None and got[2]["edges"] == 2
    assert forest.threshold_sweep(e, nodes_of(spark, []), [1]).collect() == []
