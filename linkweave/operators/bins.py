"""Positions, intervals and contact maps. Sites and placements are (contig, pos, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def offsets(contigs: DataFrame) -> DataFrame:
    """(contig, length, offset): running start of each contig in order of contig.

    Contig tables are small next to placements; ranges of ids keep the running sum from one task all the same.
    """
    part = contigs.withColumn("part", F.floor(F.col("contig") / 4096))
    base = part.groupBy("part").agg(F.sum("length").alias("l"))
    base = base.withColumn("base", F.coalesce(F.sum("l").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("l")
    own = F.coalesce(F.sum("length").over(W.partitionBy("part").orderBy("contig").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("own", own).join(base, "part").select("contig", "length", (F.col("own") + F.col("base")).alias("offset"))


def genome_bins(placed: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Adds the bin of contig offset + pos."""
    return placed.join(offsets(contigs).select("contig", "offset"), "contig").withColumn("bin", F.expr(f"(offset + pos) div {size}")).drop("offset")


def site_bins(sites: DataFrame, width: int, min_sites: int) -> DataFrame:
    """(contig, pos, bin): a contig's n sites spread evenly over n div width bins (one more if the rest is half a width and n
    exceeds it, one at least). Contigs of one bin with fewer than ``min_sites`` sites are masked (-1)."""
    w = W.partitionBy("contig")
    s = sites.select("contig", "pos").withColumns({"i": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count("*").over(w)})
    bins = F.greatest(F.lit(1), F.floor(F.col("n") / width) + F.when((F.col("n") % width >= width / 2) & (F.col("n") > width), 1).otherwise(0))
    s = s.withColumn("bins", bins)
    b = F.when((F.col("bins") == 1) & (F.col("n") < min_sites), -1).otherwise(F.floor(F.col("i") * F.col("bins") / F.col("n")))
    return s.select("contig", "pos", b.cast("long").alias("bin"))


def bin_centres(binned: DataFrame) -> DataFrame:
    return binned.filter("bin >= 0").groupBy("contig", "bin").agg(F.avg("pos").alias("centre"))


def fragments(sites: DataFrame) -> DataFrame:
    """(contig, start, stop): stretches between consecutive different sites of a contig."""
    s = sites.select("contig", "pos").distinct()
    nxt = F.lead("pos").over(W.partitionBy("contig").orderBy("pos"))
    return s.select("contig", F.col("pos").alias("start"), nxt.alias("stop")).filter("stop is not null")


def segments(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, start, stop): contigs of 1..length split at sites: stretches between sites, without the sites themselves."""
    s = sites.select("contig", "pos").distinct()
    prev = F.lag("pos", 1, 0).over(W.partitionBy("contig").orderBy("pos"))
    inner = s.select("contig", (prev + 1).alias("start"), (F.col("pos") - 1).alias("stop"))
    tail = s.groupBy("contig").agg(F.max("pos").alias("last")).join(contigs, "contig").select("contig", (F.col("last") + 1).alias("start"), F.col("length").alias("stop"))
    return inner.unionByName(tail).filter("start <= stop")


def nearest_below(points: DataFrame, sites: DataFrame, circular: bool = True) -> DataFrame:
    """Adds ``site``: the last site of the contig not after pos; before the first one the contig's last site, if circular.

    Points and sites are put in one order per contig and the last site seen is carried on; no pairs are formed.
    """
    names = points.columns
    both = points.select(*names, F.lit(None).cast("long").alias("s"), F.lit(1).alias("k")).unionByName(sites.select("contig", "pos", F.col("pos").alias("s"), F.lit(0).alias("k")).distinct(), allowMissingColumns=True)
    w = W.partitionBy("contig")
    seen = F.last("s", ignorenulls=True).over(w.orderBy("pos", "k").rowsBetween(W.unboundedPreceding, 0))
    wrap = F.max("s").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) if circular else F.lit(None)
    return both.withColumn("site", F.coalesce(seen, wrap)).filter("k = 1").select(*names, "site")


def runs(covered: DataFrame) -> DataFrame:
    """(contig, start, stop): maximal stretches of consecutive covered positions."""
    c = covered.select("contig", "pos").distinct()
    group = F.col("pos") - F.row_number().over(W.partitionBy("contig").orderBy("pos"))
    return c.withColumn("g", group).groupBy("contig", "g").agg(F.min("pos").alias("start"), F.max("pos").alias("stop")).drop("g")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """(contig, start, stop): unions of intervals that touch or overlap (ends inclusive)."""
    w = W.partitionBy("contig").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    g = intervals.withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("contig", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def covering(points: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """Points (contig, pos, ...) with each interval (contig, start, stop, ...) that holds them, ends inclusive.

    Intervals are entered in every bucket of positions that they touch, points in theirs; buckets meet by equality.
    """
    i = intervals.withColumn("b", F.explode(F.expr(f"sequence(start div {bucket}, stop div {bucket})")))
    p = points.withColumn("b", F.expr(f"pos div {bucket}"))
    return p.join(i, ["contig", "b"]).filter("start <= pos and pos <= stop").drop("b")


def overlapping(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """(contig, a_id, b_id): intervals of two sets (id, contig, start, stop) that overlap.

    A pair meets in all buckets that both touch and counts in the first of them.
    """
    one = a.select("contig", F.col("id").alias("a_id"), F.col("start").alias("a0"), F.col("stop").alias("a1")).withColumn("b", F.explode(F.expr(f"sequence(a0 div {bucket}, a1 div {bucket})")))
    two = b.select("contig", F.col("id").alias("b_id"), F.col("start").alias("b0"), F.col("stop").alias("b1")).withColumn("b", F.explode(F.expr(f"sequence(b0 div {bucket}, b1 div {bucket})")))
    met = one.join(two, ["contig", "b"]).filter(f"a0 <= b1 and b0 <= a1 and b = greatest(a0, b0) div {bucket}")
    return met.select("contig", "a_id", "b_id")


def masked_coverage(hits: DataFrame, min_identity: float, min_share: float) -> DataFrame:
    """(query, ref, score): per base the best identity of the hits that cover it (0 elsewhere), averaged over the query.

    hits(query, ref, start, stop, identity, size), half-open. A sweep over all starts and stops cuts each pair into segments;
    a segment's identity is the best of the hits that hold it, met by the segment's order.
    """
    good = hits.filter(F.col("identity") >= min_identity)
    keys = ["query", "ref"]
    points = good.select(*keys, F.explode(F.array("start", "stop")).alias("p")).distinct()
    seg = points.withColumn("q", F.lead("p").over(W.partitionBy(*keys).orderBy("p"))).filter("q is not null")
    held = seg.join(good, keys).filter("start <= p and q <= stop").groupBy(*keys, "p", "q").agg(F.max("identity").alias("best"), F.first("size").alias("size"))
    score = held.groupBy(*keys).agg((F.sum((F.col("q") - F.col("p")) * F.col("best")) / 100 / F.first("size")).alias("score"))
    return score.filter(F.col("score") > min_share)


def contact_map(placed: DataFrame) -> DataFrame:
    """(bin_i, bin_j, n), bin_i <= bin_j: forward and reverse placements (read, rev, bin) of a read, folded to one triangle."""
    fwd = placed.filter(~F.col("rev")).select("read", F.col("bin").alias("a"))
    rev = placed.filter("rev").select("read", F.col("bin").alias("b"))
    pairs = fwd.join(rev, "read").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.groupBy(F.least("a", "b").alias("bin_i"), F.greatest("a", "b").alias("bin_j")).agg(F.sum("n").alias("n"))


def scaled_map(cells: DataFrame, bins: DataFrame, reads: DataFrame) -> DataFrame:
    """(bin_i, bin_j, v): cells within a contig divided by the contig's share of reads and of length; all divided by the sum.

    bins(bin, contig), reads(contig, n, length).
    """
    total = reads.agg(F.sum("n").alias("tn"), F.sum("length").alias("tl"))
    part = reads.join(F.broadcast(total)).select("contig", (F.col("n") / F.col("tn") * F.col("length") / F.col("tl")).alias("f"))
    c = cells.join(bins.select(F.col("bin").alias("bin_i"), F.col("contig").alias("ci")), "bin_i").join(bins.select(F.col("bin").alias("bin_j"), F.col("contig").alias("cj")), "bin_j")
    c = c.join(part, F.col("ci") == F.col("contig"), "left")
    c = c.select("bin_i", "bin_j", F.when(F.col("ci") == F.col("cj"), F.col("n") / F.col("f")).otherwise(F.col("n").cast("double")).alias("v"))
    return c.join(F.broadcast(c.agg(F.sum("v").alias("s")))).select("bin_i", "bin_j", (F.col("v") / F.col("s")).alias("v"))


def block_map(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(ci, cj, mean): mean of the nonzero cells of each pair of contigs."""
    c = cells.join(bins.select(F.col("bin").alias("bin_i"), F.col("contig").alias("x")), "bin_i").join(bins.select(F.col("bin").alias("bin_j"), F.col("contig").alias("y")), "bin_j")
    return c.groupBy(F.least("x", "y").alias("ci"), F.greatest("x", "y").alias("cj")).agg(F.avg("n").alias("mean"))


def contig_graph(cells: DataFrame, bins: DataFrame, fragments: DataFrame) -> DataFrame:
    """edge(u, v, weight): (contacts + bins_u * bins_v) / (fragments_u * fragments_v): one is added to every cell, empty or not."""
    nb = bins.groupBy("contig").agg(F.count("*").alias("nb")).join(fragments, "contig")
    c = cells.join(bins.select(F.col("bin").alias("bin_i"), F.col("contig").alias("x")), "bin_i").join(bins.select(F.col("bin").alias("bin_j"), F.col("contig").alias("y")), "bin_j")
    s = c.filter("x <> y").groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.sum("n").alias("n"))
    s = s.join(nb.select(F.col("contig").alias("u"), F.col("nb").alias("b1"), F.col("n_fragments").alias("f1")), "u").join(nb.select(F.col("contig").alias("v"), F.col("nb").alias("b2"), F.col("n_fragments").alias("f2")), "v")
    return s.select("u", "v", ((F.col("n") + F.col("b1") * F.col("b2")) / (F.col("f1") * F.col("f2"))).alias("weight"))
