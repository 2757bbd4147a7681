"""Deterministic noise and synthetic graphs: every draw is a hash of a seed and a row number, so retried tasks draw the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.plans.lineage import cut


def uniform(seed: int, *keys: Column) -> Column:
    """A number of [0, 1) from a seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def noise_edges(nodes: DataFrame, edges: DataFrame, share: float, seed: int) -> DataFrame:
    """Edges with whole noise added: int(total weight * share) draws of two nodes by length, each adding 1 (loops are no draws).

    Draws meet nodes by their place on the running sum of lengths, cut into equal buckets.
    """
    w = W.partitionBy("part").orderBy("node")
    part = nodes.withColumn("part", F.floor(F.col("node") / 4096))
    base = part.groupBy("part").agg(F.sum("length").alias("l")).withColumn("base", F.coalesce(F.sum("l").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("l")
    cdf = part.withColumn("to", F.sum("length").over(w.rowsBetween(W.unboundedPreceding, 0))).join(base, "part").select("node", (F.col("base") + F.col("to") - F.col("length")).alias("low"), (F.col("base") + F.col("to")).alias("high")).filter("high > low")
    total = nodes.agg(F.sum("length").alias("t")).first()["t"] or 0
    n = int((edges.agg(F.sum("weight").alias("w")).first()["w"] or 0) * share)
    bucket = max(1, total // 1024)
    held = cdf.withColumn("b", F.explode(F.expr(f"sequence(low div {bucket}, (high - 1) div {bucket})")))
    draws = edges.sparkSession.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    draws = draws.withColumn("x", F.floor(uniform(seed, F.col("id"), F.col("end")) * total)).withColumn("b", F.expr(f"x div {bucket}"))
    hit = draws.join(held, "b").filter("low <= x and x < high").select("id", "end", "node")
    pairs = hit.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u <> v").select("u", "v", F.lit(1.0).alias("weight"))
    return edges.select("u", "v", "weight").unionByName(pairs).groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def mutated(truth: DataFrame, p_mut: float, p_indel: float, seed: int) -> DataFrame:
    """truth(obj, class, ...) with errors: with ``p_indel`` a row goes, with ``p_mut`` its class becomes another class."""
    classes = truth.select("class").distinct().withColumn("k", F.row_number().over(W.orderBy("class")) - 1)
    n = classes.count()
    kept = truth.filter(uniform(seed, F.lit("indel"), F.col("obj"), F.col("class")) >= p_indel).join(F.broadcast(classes), "class")
    step = 1 + F.floor(uniform(seed, F.lit("to"), F.col("obj"), F.col("class")) * max(n - 1, 1))
    hit = (uniform(seed, F.lit("mut"), F.col("obj"), F.col("class")) < p_mut) & F.lit(n > 1)
    moved = kept.withColumn("k", F.when(hit, F.pmod(F.col("k") + step, F.lit(n))).otherwise(F.col("k"))).drop("class")
    return moved.join(F.broadcast(classes), "k").drop("k")


def planted_partition(spark, n: int, classes: int, p_in: float, p_out: float, seed: int) -> DataFrame:
    """edge(u, v, weight) of n nodes in equal classes (node % classes): inner and outer pairs with their probabilities."""
    a = spark.range(n).select(F.col("id").alias("u"))
    pairs = a.withColumn("v", F.explode(F.sequence(F.col("u") + 1, F.lit(n)))).filter(F.col("v") < n)
    p = F.when(F.col("u") % classes == F.col("v") % classes, p_in).otherwise(p_out)
    return pairs.filter(uniform(seed, F.col("u"), F.col("v")) < p).withColumn("weight", F.lit(1.0))


def shuffled(edges: DataFrame, rounds: int, seed: int) -> DataFrame:
    """edge(u, v, weight) after rounds of swaps that keep every node's degree: (a, b), (c, d) become (a, d), (c, b) with their weights.

    In a round edges meet in pairs by hash, each in one pair at most. A swap that would make a loop, an edge that was there before the round or one
    that another swap of the round makes too is left out, so the graph stays simple.
    """
    e = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight"))
    half = max(e.count() // 2, 1)
    for i in range(rounds):
        draw = F.xxhash64(F.lit(seed), F.lit(i), "u", "v")
        h = e.select("u", "v", "weight", F.pmod(draw, F.lit(half)).alias("b"), F.struct(draw.alias("h"), "u", "v", "weight", F.pmod(F.shiftright(draw, 32), F.lit(2)).alias("turn")).alias("x"))
        pair = h.groupBy("b").agg(F.min("x").alias("x"), F.max("x").alias("y")).filter("x.h <> y.h")  # the first and last of a bucket
        a, b = F.col("x.u"), F.col("x.v")
        turned = F.col("y.turn") == 1
        c, d = F.when(turned, F.col("y.v")).otherwise(F.col("y.u")), F.when(turned, F.col("y.u")).otherwise(F.col("y.v"))
        end = lambda p, q, w: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.col(w).alias("weight"))
        new = cut(pair.select("b", "x", "y", F.explode(F.array(end(a, d, "x.weight"), end(c, b, "y.weight"))).alias("n")).select("b", "x", "y", "n.*"))
        there = e.select("u", "v", F.lit(True).alias("old"))
        twice = new.groupBy("u", "v").agg(F.count("*").alias("k"))
        bad = new.join(there, ["u", "v"], "left").join(twice, ["u", "v"]).filter("u = v or old or k > 1").select("b").distinct()
        good = cut(new.join(bad, "b", "left_anti"))
        gone = good.select(F.explode(F.array("x", "y")).alias("o")).select("o.u", "o.v").distinct()
        e = cut(e.join(gone, ["u", "v"], "left_anti").unionByName(good.select("u", "v", "weight")))
    return e


def preferential_attachment(spark, n: int, m: int, seed: int) -> DataFrame:
    """edge(u, v, weight): nodes come one by one, each with m edges to the ends of earlier edges drawn evenly, so to nodes by their degree.

    An edge's end is found alone: it copies the end at a drawn earlier place, which is either a node or another copy, until it meets
    a node; the draws are hashes, so no edge waits for another. Loops and repetitions go.
    """
    ends = spark.range(n * m).withColumn("place", 2 * F.col("id") + 1)
    follow = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("place"), lambda at, _: F.when(at % 2 == 1, F.pmod(F.xxhash64(F.lit(seed), at), at)).otherwise(at))
    arcs = ends.select(F.floor(F.col("id") / m).alias("u"), F.floor(F.floor(follow / 2) / m).alias("v")).filter("u <> v")
    return arcs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("weight", F.lit(1.0))
