"""Graphs in packs against joins, brute force and one another, however components are dealt."""

import numpy as np
import pytest

from linkweave.operators import dags, markov, pack_matrices as PM, pack_paths, packs as P, paths, transforms as T
from tests.test_graphs import bfs, graph, random_edges

#: Three components and a loop of its own.
EDGES = random_edges(14, 0.3, 3) + [(100 + a, 100 + b, w) for a, b, w in random_edges(9, 0.5, 4)] + [(200, 201, 2), (300, 300, 3)]


@pytest.fixture(params=["one", "several", "rest"])
def dealt(request, monkeypatch):
    """All in one pack; a pack a component; only small components in packs."""
    if request.param != "one":
        monkeypatch.setattr(P, "PACK_ARCS", 8)
    if request.param == "rest":
        monkeypatch.setattr(P, "MOST_ARCS", 6)
    return request.param


def values(df, name="val"):
    got = {(r["col"], r["row"]): r[name] for r in df.collect()}
    return got


def same(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_components_are_whole(spark, dealt):
    cells = graph(spark, EDGES)
    p = P.packed(cells)
    ids = [set(P.read(r["sizes"], r["data"]).ids.tolist()) for r in p.packs.collect()]
    rest = set() if p.rest is None else {r["col"] for r in p.rest.collect()}
    assert (dealt == "rest") == bool(rest)
    assert sum(map(len, ids)) + len(rest) == len(set().union(rest, *ids))
    for part in (set(range(14)), {200, 201}, {300}):
        mine = {v for a, b, _ in EDGES for v in (a, b) if v in part}
        assert mine <= rest or any(mine <= x for x in ids)


def test_matrices_in_packs(spark, dealt):
    cells = T.cut(graph(spark, EDGES))
    p = P.packed(cells)
    same(values(PM.squared(p)), values(T.product(cells, cells)))
    same(values(PM.expanded_inflated(p, 2)), values(T.Cells(T.max_loops(cells)).stochastic().expand().inflate(2).df))
    same(values(PM.co_citation(p, 2)), values(T.co_citation(cells, 2)))
    same(values(PM.inverse_log_similarity(p)), values(T.inverse_log_similarity(cells)))
    same(values(PM.flow_distance(p), "distance"), values(T.flow_distance(T.stochastic(cells), cells), "distance"))


def test_directed_cells_in_packs(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (50, 2))})
    cells = T.cut(spark.createDataFrame([(a, b, float(rng.integers(1, 5))) for a, b in rows], "col long, row long, val double"))
    same(values(PM.squared(cells)), values(T.product(cells, cells)))
    same(values(PM.co_citation(cells, 2)), values(T.co_citation(cells, 2)))
    same(values(PM.inverse_log_similarity(cells)), values(T.inverse_log_similarity(cells)))


@pytest.mark.parametrize("make", [PM.squared, lambda c: PM.expanded_inflated(c, 2), lambda c: PM.regularised_step(c, 2), lambda c: PM.co_citation(c, 2), PM.inverse_log_similarity, PM.flow_distance])
def test_no_shuffle_after_the_packs(spark, make):
    """What is made of a pack's columns isn't shuffled: the one exchange deals the packs."""
    plan = make(P.packed(graph(spark, EDGES)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_components_of_a_partition():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    home = np.arange(300)
    for _ in range(300):
        for x, y in zip(a, b):
            home[x] = home[y] = min(home[x], home[y])
    assert (P.local_components(a, b, 300) == home).all()


def by(df, key, name):
    return {r[key]: r[name] for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_paths_in_packs(spark, dealt):
    cells = T.cut(graph(spark, EDGES))
    p, far = P.packed(cells), T.cut(paths.distances(cells, cells.selectExpr("col as node").distinct()))
    assert sorted(map(tuple, paths.all_distances(p).select("source", "node", "dist").collect())) == sorted(map(tuple, far.select("source", "node", "dist").collect()))
    assert by(paths.all_eccentricities(p), "node", "ecc") == by(paths.eccentricity(far), "node", "ecc")
    want = by(paths.betweenness(cells, cells.selectExpr("col as node").distinct()), "node", "score")
    got = by(paths.all_betweenness(p), "node", "score")
    close({k: v for k, v in got.items() if v}, {k: v for k, v in want.items() if v})
    assert values(T.ceil_neighbours(p, 2)) == values(T.ceil_in_rounds(cells, 2))


def test_paths_of_more_sources_than_a_search_takes(monkeypatch):
    monkeypatch.setattr(pack_paths, "SOURCES", 70)
    monkeypatch.setattr(P, "HELD", 200)
    edges = np.array([(a, b) for a, b, _ in random_edges(150, 0.02, 8)])
    g = P.Graph.of(np.arange(150), np.append(edges[:, 0], edges[:, 1]), np.append(edges[:, 1], edges[:, 0]), np.ones(2 * len(edges)))
    got = {(s, v): d for part in range(3) for x in pack_paths.distances(g, part, 3) for s, v, d in zip(x["source"].tolist(), x["node"].tolist(), x["dist"].tolist())}
    assert got == {(s, v): d for s in range(150) for v, d in bfs([(a, b, 1) for a, b in edges.tolist()], s).items()} | {(s, s): 0 for s in range(150)}
    ecc = {v: e for part in range(3) for x in pack_paths.eccentricity(g, part, 3) for v, e in zip(x["node"].tolist(), x["ecc"].tolist())}
    assert ecc == {s: max(d for (a, _), d in got.items() if a == s) for s in range(150)}


@pytest.mark.parametrize("cycle", [False, True])
def test_layers_in_packs(spark, dealt, cycle):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2)) if a < b} | {(30, 31), (31, 32), (30, 32)} | ({(5, 2), (40, 40)} if cycle else set()))
    arcs = spark.createDataFrame(pairs, "x long, y long")
    nodes = spark.createDataFrame([(i,) for i in range(42)], "node long")
    got = {r["node"]: (r["up"], r["down"]) for r in dags.dag_attributes(arcs, nodes).collect()}
    far = {}
    for s in range(42):
        front, d, seen = {s}, 0, {}
        while front:
            d += 1
            front = {y for x, y in pairs if x in front} - seen.keys()
            seen |= dict.fromkeys(front, d)
        far[s] = seen
    assert got == {v: (-1, -1) if v in far[v] else (max(far[v].values(), default=0), max((far[s][v] for s in far if v in far[s]), default=0)) for v in far}
    if cycle:
        with pytest.raises(Exception, match="cycles"):
            dags.reduced(arcs).collect()
    else:
        assert {(r["x"], r["y"]) for r in dags.reduced(arcs).collect()} == {(r["x"], r["y"]) for r in dags.reduced_by_search(arcs).collect()}


def test_flows_in_packs(spark, dealt, monkeypatch):
    if dealt == "rest":
        monkeypatch.setattr(markov, "PACK_CELLS", 8 * markov.MOST)
    cells = T.cut(graph(spark, EDGES[:-1]))
    nodes = cells.selectExpr("col as node").distinct()
    for most in (markov.MOST, 3):
        got, want = (markov.markov_flow(cells, rounds=2, most=most), markov.blocked_flow(cells, 2.0, 2, 1e-4, markov.CUTOFF, most, 0, 0.9))
        same(values(got.cells), values(want.cells))
        assert got.rounds[0] == pytest.approx(want.rounds[0])
    graph_flow = T.cut(T.stochastic(markov.with_unit_loops(cells, nodes)))
    want = markov.regularised_flow(cells, nodes, rounds=3, graph=graph_flow)
    same(values(markov.regularised_flow(cells, nodes, rounds=3).cells), values(want.cells))


def test_ranks_and_powers_in_packs(spark, dealt):
    cells = T.cut(graph(spark, EDGES))
    p, nodes = P.packed(cells), spark.createDataFrame([(i,) for i in [*range(14), *range(100, 109), 200, 201, 300, 400, 401]], "node long")
    close(by(paths.page_rank(nodes, p), "node", "rank"), by(paths.page_rank(nodes, cells), "node", "rank"))
    same(values(PM.squared_twice(p)), values(T.step(cells, 2)))
