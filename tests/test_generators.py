"""Random graphs: what they must keep, and that a seed gives the same graph."""

from collections import Counter

from linkweave.operators import generators as G
from tests.test_graphs import random_edges


def test_shuffle_keeps_degrees(spark):
    edges = random_edges(60, 0.15, 4)
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "u long, v long, weight double")
    got = [tuple(r) for r in G.shuffled(df, 4, 1).collect()]
    degree = lambda rows: Counter(x for a, b, *_ in rows for x in (a, b))
    assert degree(got) == degree(edges) and Counter(w for _, _, w in got) == Counter(w for _, _, w in edges)
    assert all(a < b for a, b, _ in got) and len({(a, b) for a, b, _ in got}) == len(edges)
    assert len({(a, b) for a, b, _ in got} & {(a, b) for a, b, _ in edges}) < 0.6 * len(edges)
    assert sorted(got) == sorted(tuple(r) for r in G.shuffled(df.repartition(3), 4, 1).collect())
    assert G.shuffled(df.limit(0), 2, 1).collect() == []


def test_preferential_attachment_has_hubs(spark):
    rows = G.preferential_attachment(spark, 3000, 3, 5).collect()
    degree = Counter(x for r in rows for x in (r["u"], r["v"]))
    assert 0.9 * 9000 < len(rows) <= 9000 and all(0 <= r["u"] < r["v"] < 3000 for r in rows)
    assert max(degree.values()) > 15 * len(rows) / 3000 and max(degree, key=degree.get) < 100
