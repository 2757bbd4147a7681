"""Readers of alignment, variant and sequence lines on odd lines."""

import pytest

from linkweave.sources import alignments as A, converters as C
from linkweave.sources.matrices import metis


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "line string")


def test_records(spark):
    sam = A.sam(lines(spark, "@SQ\tSN:c", "r1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\t*", "r1\t256\td\t5\t60\t4M\t*\t0\t0\t*\t*", "", "r2\tx\tc"))
    assert [(r["read"], r["pos"], r["cigar"]) for r in sam.collect()] == [("r1", 5, "4M")]
    assert A.psl(lines(spark, "match\tmis", "----", "")).count() == 0
    hits = lines(spark, "# x", "a\tb\t1\t1\t0\t0\t1\t1\t1\t1\t0\t7", "b\ta\t1\t1\t0\t0\t1\t1\t1\t1\t1e-3\t9.5", "a\ta\t1\t1\t0\t0\t1\t1\t1\t1\t0\t7")
    assert [tuple(r) for r in A.blast_abc(hits).collect()] == [("a", "b", 9.5)]
    assert [tuple(r) for r in A.blast_abc(hits, "evalue").collect()] == [("a", "b", 200.0)]
    vcf = A.snps(lines(spark, "#CHROM", "c\t1\t.\tA\tG", "c\t2\t.\tA\tG,T", "c\t3\t.\tAC\tG", "c\t4\t.\tA\t."))
    assert [r["pos"] for r in vcf.collect()] == [1]
    assert A.community(lines(spark, "# c", "s1 c1 0.5", "s2 c1", "")).collect() == [("s1", "c1", 0.5)]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nAC\nGT\n>b\n>c\nA C\r\nG\n")
    records = spark.read.text(str(tmp_path), lineSep=">")
    assert sorted(tuple(r) for r in A.fasta_lengths(records).collect()) == [("a", 4), ("b", 0), ("c", 3)]


def test_metis_round_trip(spark):
    edges = spark.createDataFrame([("a", "c", 2.0), ("c", "d", 5.0)], "u string, v string, weight double")
    ids = C.node_map(spark.createDataFrame([(x,) for x in "dcbaa"], "node string"))
    assert sorted(tuple(r) for r in ids.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    written = C.metis_lines(edges, ids)
    assert sorted(tuple(r) for r in written.collect()) == [(0, "4 2 1"), (1, "3 2"), (2, ""), (3, "1 2 4 5"), (4, "3 5")]
    assert sorted(tuple(r) for r in metis(written).collect()) == [(1, 3, 2.0), (3, 1, 2.0), (3, 4, 5.0), (4, 3, 5.0)]
    assert C.metis_lines(edges.limit(0), ids.limit(0)).collect() == [(0, "0 0 1")]


def test_odd_values(spark):
    weights = C.inverse_weights(spark.createDataFrame([(1, 2, 0.0), (1, 3, 4.0)], "u long, v long, weight double"))
    assert sorted((r["v"], r["weight"]) for r in weights.collect()) == [(2, None), (3, 0.25)]
    seen = spark.createDataFrame([("A", "A", "G"), ("G", "A", "G"), ("T", "A", "G"), (None, "A", "G")], "base string, ref string, alt string")
    assert sorted(r["base"] for r in A.known_alleles(seen).collect()) == ["A", "G"]


def test_backbone_and_coverage(spark):
    text = lines(spark, "seq0_leftend\tseq0_rightend\tseq1_leftend\tseq1_rightend", "1\t10\t-5\t-9", "0\t0\t4\t8", "", "3\t5\t7\t7")
    assert sorted(tuple(r) for r in A.backbone(text, 2).collect()) == [(0, 1, 10, 1, 9), (0, 3, 5, 2, 2), (1, 4, 8, 1, 4), (1, 7, 7, 2, 0)]
    assert sorted(tuple(r) for r in A.backbone(text, 2, reverse=True).collect())[2:3] == [(1, -5, -9, 2, 4)]
    with pytest.raises(Exception, match="fields of the line: 4"):
        A.backbone(text, 3).collect()
    assert A.backbone(lines(spark), 2).count() == 0
    cover = lines(spark, "#ID\tAvg", "c1 some words\t2.5\t0\t0\t0\t0\t0\t0\t0.4", "c2\tx\t0\t0\t0\t0\t0\t0\t1", "c3\t1", "")
    assert [tuple(r) for r in A.coverage_table(cover).collect()] == [("c1", 2.5, 0.4), ("c2", None, 1.0)]
