"""Hierarchies of clusterings against loops, and their queries against SQL."""

import itertools

import pytest

from linkweave.operators import hierarchy as H
from tests.test_graphs import graph, nodes_of

CLIQUES = [(5 * c + a, 5 * c + b, 4) for c in range(6) for a, b in itertools.combinations(range(5), 2)]
LINKS = [(15 * g + 5 * a, 15 * g + 5 * b, 1) for g in range(2) for a, b in itertools.combinations(range(3), 2)]


def test_contraction_of_cliques_of_cliques(spark):
    nodes = nodes_of(spark, range(31))
    got = H.contraction_levels(graph(spark, CLIQUES + LINKS), nodes).collect()
    levels = {}
    for r in got:
        levels.setdefault(r["level"], {}).setdefault(r["cluster"], set()).add(r["node"])
    small, large = [{frozenset(range(k * c, k * c + k)) for c in range(30 // k)} | {frozenset([30])} for k in (5, 15)]
    assert [{frozenset(v) for v in levels[i].values()} for i in sorted(levels)] == [small, large]
    spark_levels = spark.createDataFrame(got)
    labels = {(r["level"], r["cluster"]): (r["low"], r["high"]) for r in H.interval_labels(spark_levels).collect()}
    assert all(high - low + 1 == len(levels[level][c]) for (level, c), (low, high) in labels.items())
    stable = {tuple(r) for r in H.stable_clusters(spark_levels).select("name", "size", "first", "last").collect()}
    assert stable == {(5 * c, 5, 1, 1) for c in range(6)} | {(0, 15, 2, 2), (15, 15, 2, 2), (30, 1, 1, 2)}


def test_contracted_weights(spark):
    part = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "cluster long, node long")
    cells = graph(spark, [(0, 2, 3), (1, 2, 5), (0, 1, 7)])
    assert {(r["col"], r["row"]): r["val"] for r in H.contracted(cells, part, False).collect()} == {(0, 2): 4.0, (2, 0): 8.0}
    assert {(r["col"], r["row"]): r["val"] for r in H.contracted(cells, part).collect()} == {(0, 2): 12.0, (2, 0): 12.0}


def test_levels_that_are_not_nested(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x"), (2, 1, "x"), (2, 2, "y")]
    levels = spark.createDataFrame(rows, "level long, node long, cluster string")
    with pytest.raises(ValueError):
        H.interval_labels(levels)
    assert [tuple(r)[:5] for r in H.chain_distances(levels, "coarse").collect()] == [(1, 2, 1, 1, 4)]
    assert [tuple(r) for r in H.level_pairs(levels, "first").collect()] == [(1, 2)]


def test_projection_and_trivial(spark):
    nodes = nodes_of(spark, [3, 4, 5])
    assert sorted(map(tuple, H.trivial(nodes, "top").collect())) == [(3, 3), (3, 4), (3, 5)]
    part = spark.createDataFrame([("a", 3), ("a", 9), ("b", 10)], "cluster string, node long")
    assert [tuple(r) for r in H.projected(part, nodes).collect()] == [("a", 3)]


def test_sweep_over_inflations(spark):
    cells, nodes = graph(spark, CLIQUES + LINKS), nodes_of(spark, range(30))
    truth = spark.createDataFrame([(i, i // 5) for i in range(30)], "node long, class long")
    row = H.inflation_sweep(cells, nodes, [2.0], truth).first()
    assert (row["clusters"], row["single"], row["largest"], round(row["v"], 9)) == (6, 0, 5, 1.0) and row["mass"] > 0.99
