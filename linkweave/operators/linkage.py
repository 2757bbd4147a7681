"""From placements of reads to weighted linkage graphs, and the gates on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def arcs(placement: DataFrame, min_mapq: float = 10) -> DataFrame:
    """cell(col, row, val): inserts whose forward read lies on ``col`` and reverse read on another contig, ``row``.

    "Opposite directions among the placements of an insert" equals the product of its forward and reverse placements,
    so one equi-join on the insert does it, without a row number.
    """
    return met(placement, min_mapq).groupBy("col", "row").agg(F.count("*").cast("double").alias("val"))


def met(placement: DataFrame, min_mapq: float) -> DataFrame:
    """(col, row) of each pair of a forward and a reverse read of an insert on two contigs."""
    good = placement.filter(F.col("mapq") >= min_mapq)
    fwd = good.filter(~F.col("rev")).select("read", F.col("contig").alias("col"))
    rev = good.filter("rev").select("read", F.col("contig").alias("row"))
    return fwd.join(rev, "read").filter("col <> row").select("col", "row")


def linkage(placement: DataFrame, min_mapq: float = 10) -> DataFrame:
    """edge(u, v, weight), u < v: opposite-strand pairs of an insert per unordered pair of contigs."""
    ends = [F.least("col", "row").alias("u"), F.greatest("col", "row").alias("v")]
    return met(placement, min_mapq).groupBy(*ends).agg(F.count("*").cast("double").alias("weight"))


def linkage_all_pairs(placement: DataFrame) -> DataFrame:
    """edge(u, v, weight), u <= v: all pairs of placements of an insert.

    Counts per (insert, contig) first: n_u * n_v pairs for different contigs and n (n - 1) / 2 within one.
    """
    n = placement.groupBy("read", "contig").agg(F.count("*").alias("n"))
    other = n.select("read", F.col("contig").alias("contig2"), F.col("n").alias("n2"))
    pairs = n.join(other, "read").filter("contig <= contig2")
    w = F.when(F.col("contig") == F.col("contig2"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("n2"))
    return pairs.groupBy(F.col("contig").alias("u"), F.col("contig2").alias("v")).agg(F.sum(w).alias("weight")).filter("weight > 0")


def linkage_quality(placement: DataFrame) -> DataFrame:
    """edge with weight and whole mean mapping quality: a pair's quality is the sum of its two, at most 60."""
    fwd = placement.filter(~F.col("rev")).select("read", F.col("contig").alias("c1"), F.col("mapq").alias("q1"))
    rev = placement.filter("rev").select("read", F.col("contig").alias("c2"), F.col("mapq").alias("q2"))
    pairs = fwd.join(rev, "read").filter("c1 <> c2")
    ends = [F.least("c1", "c2").alias("u"), F.greatest("c1", "c2").alias("v")]
    return pairs.groupBy(*ends).agg(F.count("*").alias("weight"), F.floor(F.avg(F.least(F.lit(60.0), F.col("q1") + F.col("q2")))).alias("mapq"))


def paired_ends(placement: DataFrame) -> DataFrame:
    """Inserts with exactly one forward and one reverse placement, on different contigs."""
    n = placement.groupBy("read").agg(F.count_if(~F.col("rev")).alias("nf"), F.count_if("rev").alias("nr"), F.max(F.when(~F.col("rev"), F.col("contig"))).alias("contig1"), F.max(F.when(F.col("rev"), F.col("contig"))).alias("contig2"))
    return n.filter("nf = 1 and nr = 1 and contig1 <> contig2").select("read", "contig1", "contig2")


def long_nodes(nodes: DataFrame, least: int, strict: bool = True) -> DataFrame:
    """Nodes over a length (``strict``), or of at least that length."""
    return nodes.filter(F.col("length") > least if strict else F.col("length") >= least)


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node")
    return edges.join(ids.withColumnRenamed("node", "u"), "u", "left_semi").join(ids.withColumnRenamed("node", "v"), "v", "left_semi")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end among the nodes."""
    ids = nodes.select("node")
    one = edges.join(ids.withColumnRenamed("node", "u"), "u", "left_semi")
    return one.unionByName(edges.join(ids.withColumnRenamed("node", "u"), "u", "left_anti").join(ids.withColumnRenamed("node", "v"), "v", "left_semi"))


def ends(edges: DataFrame) -> DataFrame:
    """The distinct nodes that have an edge to another node."""
    e = edges.filter("u <> v")
    return e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge to another node."""
    return nodes.join(ends(edges), "node", "left_anti")


def drop_light(nodes: DataFrame, edges: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """Edges over a weight, and the nodes that still have one."""
    kept = edges.filter(F.col("weight") > most)
    return nodes.join(ends(kept), "node", "left_semi"), kept


def with_loops(nodes: DataFrame, edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """Edges and a loop of the given weight at each node that has none."""
    loops = nodes.join(edges.filter("u = v").select(F.col("u").alias("node")), "node", "left_anti")
    return edges.select("u", "v", "weight").unionByName(loops.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(weight).alias("weight")))


def gate(placement: DataFrame, min_coverage: float, min_identity: float) -> DataFrame:
    return placement.filter((F.col("coverage") >= min_coverage) & (F.col("identity") >= min_identity))


def remove_hubs(edges: DataFrame, most: int) -> DataFrame:
    """Edges among nodes of at most ``most`` neighbours, the survivors numbered anew from 0 by id.

    Survivors are numbered by ranges: counts of ranges of ids give each range its offset, so no task orders all nodes.
    """
    both = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    degree = both.groupBy("node").count()
    keep = degree.filter(F.col("count") <= most).select("node")
    kept = among(edges, keep)
    number = renumber(ends(kept), "node")
    return (
        kept.join(number.withColumnsRenamed({"node": "u", "number": "nu"}), "u")
        .join(number.withColumnsRenamed({"node": "v", "number": "nv"}), "v")
        .select(F.col("nu").alias("u"), F.col("nv").alias("v"), "weight")
    )


def renumber(ids: DataFrame, name: str, range_size: int = 4096) -> DataFrame:
    """(name, number): distinct whole-number ids numbered from 0 in ascending order."""
    from pyspark.sql import Window as W

    part = ids.select(name).distinct().withColumn("part", F.floor(F.col(name) / range_size))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy("part").orderBy(name))
    return part.join(offsets, "part").select(name, (F.col("offset") + rank - 1).alias("number"))


def best_reference(hits: DataFrame, query: str, ref: str, length: str) -> DataFrame:
    """Per query the reference with the greatest total aligned length; ties go to the smaller reference."""
    sums = hits.groupBy(query, ref).agg(F.sum(length).alias("total"))
    return sums.groupBy(query).agg(F.max(F.struct(F.col("total"), (-F.col(ref)).alias("r"))).alias("best")).select(query, (-F.col("best.r")).alias(ref), F.col("best.total").alias("total"))


def sample_edges(edges: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Each edge with probability ``share``, decided by a hash of its ends and the seed (the same on every run)."""
    return edges.filter(F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def in_cluster(edges: DataFrame, membership: DataFrame, inside: bool = True) -> DataFrame:
    """Edges whose ends share a cluster (``inside``), or share none."""
    a = membership.select(F.col("node").alias("u"), F.col("cluster").alias("cu"))
    b = membership.select(F.col("node").alias("v"), F.col("cluster").alias("cv"))
    same = edges.join(a, "u").join(b, "v").filter("cu = cv").select("u", "v").distinct()
    return edges.join(same, ["u", "v"], "left_semi" if inside else "left_anti")


def phred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)
