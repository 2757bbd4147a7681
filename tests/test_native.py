"""Native matrices and tables of edges and nodes, read from text and written back."""

import pytest
from pyspark.sql import functions as F

from linkweave.sources import native as N
from tests.test_graphs import graph, nodes_of, random_edges

TEXT = """# a comment
(mclheader
mcltype matrix
dimensions 12x5
)
(mclcols 0 3 7 8
 11 $
)
(mclmatrix
begin
0 1:0.5 2
   4:3e-1 $
3 0 $
7 $   # empty
8
 8:2 11:1 $
)
"""


def cells(df):
    return {(r["col"], r["row"]): r["val"] for r in df.collect()}


def test_read_native(spark, tmp_path):
    path = f"{tmp_path}/a.mci"
    with open(path, "w") as f:
        f.write(TEXT)
    whole = {(0, 1): 0.5, (0, 2): 1.0, (0, 4): 0.3, (3, 0): 1.0, (8, 8): 2.0, (8, 11): 1.0}
    assert cells(N.read_matrix(spark, path)) == whole
    assert sorted(r["col"] for r in N.vectors(spark, path).collect()) == [0, 3, 7, 8]
    part = N.read_matrix(spark, path, nodes_of(spark, [0, 8]), nodes_of(spark, [2, 8]))
    assert cells(part) == {(0, 2): 1.0, (8, 8): 2.0}
    assert tuple(N.read_dimensions(spark, path).first()) == (12, 5)
    sides = {}
    for r in N.read_domains(spark, path).collect():
        sides.setdefault(r["side"], set()).add(r["node"])
    assert sides == {"cols": {0, 3, 7, 8, 11}, "rows": set(range(12))}
    plan = N.read_matrix(spark, path).filter("col = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("= 3)")  # the filter lies below


@pytest.mark.parametrize("span, listed", [(4096, False), (3, False), (3, True)])
def test_round_trip(spark, tmp_path, monkeypatch, span, listed):
    monkeypatch.setattr(N, "SPAN", span)
    c = graph(spark, [(a, b, w / 4) for a, b, w in random_edges(30, 0.3, 3)])
    nodes = nodes_of(spark, [*range(30), 100]) if listed else None
    N.write_matrix(c.repartition(5), f"{tmp_path}/m", nodes)
    assert cells(N.read_matrix(spark, f"{tmp_path}/m")) == cells(c)
    assert tuple(N.read_dimensions(spark, f"{tmp_path}/m").first()) == ((31, 31) if listed else (30, 30))
    ids = {r["node"] for r in N.read_domains(spark, f"{tmp_path}/m").filter("side = 'cols'").collect()}
    assert ids == ({*range(30), 100} if listed else set(range(30)))


def test_empty_matrix(spark, tmp_path):
    c = graph(spark, [(1, 2, 1)]).limit(0)
    N.write_matrix(c, f"{tmp_path}/m")
    assert N.read_matrix(spark, f"{tmp_path}/m").collect() == [] and tuple(N.read_dimensions(spark, f"{tmp_path}/m").first()) == (0, 0)


def test_tables(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 3.5), (2, 9, 1.0)], "u long, v long, weight double")
    N.write_table(N.edge_table(e), f"{tmp_path}/e")
    back = N.read_edges(spark, f"{tmp_path}/e")
    assert sorted(map(tuple, back.collect())) == [("1", "2", 3.5, "UNDIRECTED"), ("2", "9", 1.0, "UNDIRECTED")]
    N.write_table(N.node_table(nodes_of(spark, [4, 7])), f"{tmp_path}/n")
    assert sorted(map(tuple, N.read_nodes(spark, f"{tmp_path}/n").collect())) == [("4", 1), ("7", 1)]
    (tmp_path / "bad").write_text("SOURCE TARGET RAWWEIGHT TYPE\na b heavy UNDIRECTED\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        N.read_edges(spark, f"{tmp_path}/bad").collect()


def test_dumps(spark):
    c = spark.createDataFrame([(0, 1, 2.0), (1, 0, 0.5), (1, 1, 3.0)], "col long, row long, val double")
    lines = lambda *a, **k: sorted(r["line"] for r in N.dump_lines(c, *a, **k).collect())
    assert lines() == ["0\t1\t2", "1\t0\t0.5", "1\t1\t3"]
    assert lines("upper") == ["0\t1\t2"] and lines("loweri", sep=" ") == ["1 0 0.5", "1 1 3"] and lines("noloop", values=False) == ["0\t1", "1\t0"]
    tab = spark.createDataFrame([(0, "a")], "id long, label string")
    assert lines("upperi", tab=tab) == ["?\t?\t3", "a\t?\t2"]


@pytest.mark.parametrize("listed", [False, True])
def test_files_hold_whole_vectors(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(N, "SPAN", 2)  # many lines a vector
    c = graph(spark, [(a, b, w / 4) for a, b, w in random_edges(60, 0.5, 4)])
    nodes = nodes_of(spark, [*range(60), 100]) if listed else None
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        [spark.conf.set(k, v) for k, v in conf.items()]
        N.write_matrix(c, f"{tmp_path}/m", nodes)
    finally:
        [spark.conf.set(k, v) for k, v in before.items()]
    files = sorted((tmp_path / "m").glob("part-*"))
    assert len(files) > 8
    for f in files[1:-1]:
        assert f.read_text().rstrip().endswith("$")
    assert cells(N.read_matrix(spark, f"{tmp_path}/m")) == cells(c)
    ids = {r["node"] for r in N.read_domains(spark, f"{tmp_path}/m").filter("side = 'cols'").collect()}
    assert ids == ({*range(60), 100} if listed else set(range(60)))
