"""Summaries of graphs, clusterings and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.operators.transforms import mirrored


def column_stats(cells: DataFrame) -> DataFrame:
    """(col, n, sum, max, min, mean) of each column."""
    v = F.col("val")
    return cells.groupBy("col").agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolates, mean and median degree."""
    deg = mirrored(edges).filter("col <> row").groupBy("col").agg(F.count("*").alias("d"))
    d = nodes.select(F.col("node").alias("col")).join(deg, "col", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return d.agg(F.count("*").alias("n_nodes"), (F.sum("d") / 2).cast("long").alias("n_edges"), F.count_if(F.col("d") == 0).alias("isolates"), F.avg("d").alias("mean"), F.median("d").cast("double").alias("median"))


def spread(df: DataFrame, name: str) -> DataFrame:
    """One row: mean, median, interquartile range and population deviation of a column."""
    q = F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.avg(name).alias("mean"), F.stddev_pop(name).alias("sd"), q.alias("q")).select("mean", "sd", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster").agg(F.count("*").alias("size"))


def granularity(membership: DataFrame) -> DataFrame:
    """One row: n, max, ctr (sum of squares / sum), avg, min, singletons, quartletons, and the number of largest clusters
    that hold half of all nodes (twi) with the size of the last of them (twl).

    Clusters are counted by size first, so the running sum goes over distinct sizes only.
    """
    s = sizes(membership)
    by = s.groupBy("size").agg(F.count("*").alias("k"))
    down = W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    run = by.withColumns({"held": F.sum(F.col("k") * F.col("size")).over(down), "upto": F.sum("k").over(down)})
    total = s.agg(F.count("*").alias("n"), F.max("size").alias("max"), (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("ctr"), F.avg("size").alias("avg"), F.min("size").alias("min"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") <= 4).alias("quartletons"), F.sum("size").alias("nodes"))
    half = run.join(F.broadcast(total.select("nodes"))).filter("2 * held >= nodes").agg(F.max(F.struct("size", "held", "upto", "nodes")).alias("x"))
    short = F.floor((F.col("x.held") - F.ceil(F.col("x.nodes") / 2)) / F.col("x.size"))
    return total.drop("nodes").join(half.select((F.col("x.upto") - short).alias("twi"), F.col("x.size").alias("twl")))


def inside_cells(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """Cells (cluster, col, row, val) whose ends share a cluster, once for each cluster that they share."""
    a = membership.select("cluster", F.col("node").alias("col"))
    b = membership.select(F.col("cluster").alias("c2"), F.col("node").alias("row"))
    return cells.join(a, "col").join(b, "row").filter("cluster = c2").select("cluster", "col", "row", "val")


def performance(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: mass fraction (mean share of a node's weight inside its cluster), area fraction, and coverage (mean of the
    square of that share over the share of squared weights)."""
    own = inside_cells(cells, membership).groupBy("cluster", "col").agg(F.sum("val").alias("si"))
    every = cells.groupBy("col").agg(F.sum("val").alias("s"))
    hits = membership.select("cluster", F.col("node").alias("col")).join(own, ["cluster", "col"], "left").join(every, "col", "left")
    share = F.coalesce(F.col("si") / F.nullif("s", F.lit(0.0)), F.lit(0.0))
    mass = hits.agg(F.avg(share).alias("mass_fraction"))
    n = membership.select("node").distinct().agg(F.count("*").alias("n"))
    area = sizes(membership).agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("a")).join(n).select((F.col("a") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("area_fraction"))
    return mass.join(area)


def cluster_density(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, size, density): weight of the arcs inside over size * (size - 1), loops left out."""
    inner = inside_cells(cells.filter("col <> row"), membership).groupBy("cluster").agg(F.sum("val").alias("w"))
    s = sizes(membership).join(inner, "cluster", "left")
    return s.select("cluster", "size", (F.coalesce("w", F.lit(0.0)) / F.nullif(F.col("size") * (F.col("size") - 1), F.lit(0))).alias("density"))


def cuts(cells: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, volume, cut, total): a partition's clusters with their arc weight, that which leaves, and all weight."""
    a = partition.select("cluster", F.col("node").alias("col"))
    b = partition.select(F.col("cluster").alias("c2"), F.col("node").alias("row"))
    per = cells.join(a, "col").join(b, "row").groupBy("cluster").agg(F.sum("val").alias("volume"), F.sum(F.when(F.col("cluster") != F.col("c2"), F.col("val")).otherwise(0.0)).alias("cut"))
    return per.join(F.broadcast(per.agg(F.sum("volume").alias("total"))))


def conductance(cells: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, ncut, conductance): cut over volume, and over the smaller of volume and the rest."""
    c = cuts(cells, partition)
    low = F.least("volume", F.col("total") - F.col("volume"))
    return c.select("cluster", (F.col("cut") / F.nullif("volume", F.lit(0.0))).alias("ncut"), (F.col("cut") / F.nullif(low, F.lit(0.0))).alias("conductance"))


def modularity(cells: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: modularity of a partition of an undirected graph given by both arcs of each edge."""
    c = cuts(cells, partition)
    return c.agg(F.sum((F.col("volume") - F.col("cut")) / F.col("total") - F.pow(F.col("volume") / F.col("total"), 2)).alias("modularity"))


def node_scores(cells: DataFrame, membership: DataFrame) -> DataFrame:
    """(col, cluster, n, weight, share): each node's arcs into each cluster that it touches."""
    b = membership.select("cluster", F.col("node").alias("row"))
    every = cells.groupBy("col").agg(F.sum("val").alias("s"))
    per = cells.join(b, "row").groupBy("col", "cluster").agg(F.count("*").alias("n"), F.sum("val").alias("weight"))
    return per.join(every, "col").select("col", "cluster", "n", "weight", (F.col("weight") / F.col("s")).alias("share"))


def sanity(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: nodes in no cluster, nodes in several, and memberships beyond the first."""
    n = nodes.select("node").join(membership.groupBy("node").agg(F.count("*").alias("k")), "node", "left")
    return n.agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k") > 1).alias("overlap"), F.coalesce(F.sum(F.greatest(F.col("k") - 1, F.lit(0))), F.lit(0)).alias("excess"))


def log2_histogram(df: DataFrame, name: str) -> DataFrame:
    """(bin, n): values by the floor of their binary logarithm."""
    return df.filter(F.col(name) > 0).groupBy(F.floor(F.log2(name)).alias("bin")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, name: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): values of [low, high) by equal bins from 1; 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(name, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def scale_free_fit(degrees: DataFrame, name: str) -> DataFrame:
    """One row: squared correlation of ln degree with ln of the number of nodes of at least that degree."""
    by = degrees.filter(F.col(name) > 0).groupBy(name).agg(F.count("*").alias("k"))
    cum = by.withColumn("c", F.sum("k").over(W.orderBy(F.desc(name)).rowsBetween(W.unboundedPreceding, 0)))
    return cum.agg(F.pow(F.corr(F.ln(name), F.ln("c")), F.lit(2.0)).alias("r2"))


def source_entropy(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: length-weighted mean over contigs of the entropy (bits) of their source classes, each with one added.

    counts(contig, source, n): only contigs with reads; lengths(contig, length).
    """
    sources = counts.select("source").distinct()
    full = counts.select("contig").distinct().join(F.broadcast(sources)).join(counts, ["contig", "source"], "left")
    n = F.coalesce("n", F.lit(0)) + 1
    per = full.withColumn("x", n).groupBy("contig").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.log2("x")).alias("sl"))
    per = per.select("contig", (F.log2("s") - F.col("sl") / F.col("s")).alias("h")).join(lengths, "contig")
    return per.agg((F.sum(F.col("h") * F.col("length")) / F.sum("length")).alias("entropy"))


def shared_extent(table: DataFrame, genomes: list[str], size: str) -> DataFrame:
    """(n, genome, extent): extent of rows by number of genomes that they hold, with margins (n -1, genome
    ``all``)."""
    n = sum((F.col(g).cast("long") for g in genomes[1:]), F.col(genomes[0]).cast("long"))
    long = table.select(n.alias("n"), size, F.explode(F.array_compact(F.array(*[F.when(F.col(g), F.lit(g)) for g in genomes]))).alias("genome"))
    margins = long.cube("n", "genome").agg(F.sum(size).alias("extent"))
    return margins.select(F.coalesce("n", F.lit(-1)).cast("long").alias("n"), F.coalesce("genome", F.lit("all")).alias("genome"), "extent")


def averaged_rank(df: DataFrame, by: list[str], value: str) -> Column:
    """Rank by value within groups; ties share the mean of their places."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2
