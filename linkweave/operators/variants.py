"""Variant sites: allele ratios, links between sites, likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def allele_ratio(reads: DataFrame) -> DataFrame:
    """(contig, site, ref, var, ratio, depth) of reads (contig, site, is_var): ratio = var / depth, 0 without variants."""
    out = reads.groupBy("contig", "site").agg(F.count_if(~F.col("is_var")).alias("ref"), F.count_if("is_var").alias("var"), F.count("*").alias("depth"))
    return out.select("contig", "site", "ref", "var", (F.col("var") / F.col("depth")).alias("ratio"), "depth")


def site_links(seen: DataFrame) -> DataFrame:
    """(s1, s2, n), s1 < s2: fragments (fragment, end, site) whose two ends see the two sites."""
    one = seen.filter("end = 1").select("fragment", F.col("site").alias("a"))
    two = seen.filter("end = 2").select("fragment", F.col("site").alias("b"))
    pairs = one.join(two, "fragment").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.groupBy(F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2")).agg(F.sum("n").alias("n"))


def four_way(links: DataFrame, ratios: DataFrame) -> DataFrame:
    """(n1, n2, weight): each link of two sites as four links of their ref and var nodes, shared out by the allele ratios."""
    r = ratios.select("site", "ratio")
    j = links.join(r.withColumnsRenamed({"site": "s1", "ratio": "r1"}), "s1").join(r.withColumnsRenamed({"site": "s2", "ratio": "r2"}), "s2")
    node = lambda s, k: F.concat(F.col(s).cast("string"), F.lit(f".{k}"))
    part = {"ref": lambda c: 1 - F.col(c), "var": lambda c: F.col(c)}
    four = F.array(*[F.struct(node("s1", a).alias("n1"), node("s2", b).alias("n2"), (F.col("n") * part[a]("r1") * part[b]("r2")).alias("weight")) for a in part for b in part])
    return j.select(F.explode(four).alias("x")).select("x.*").filter("weight > 0")


def multinomial_score(observed: DataFrame) -> DataFrame:
    """(edge, score): multinomial log-likelihood (without the constant) of counts (edge, cell, n, p): sum n ln p."""
    return observed.groupBy("edge").agg(F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln("p")).otherwise(0.0)).alias("score"))
