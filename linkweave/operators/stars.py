"""Covers of a graph by overlapping stars, found in rounds that give what a walk over the nodes one by one would give.

Rule. Hubs: nodes come by falling relevance; one becomes a hub if itself or a neighbour is in no star so far, and its star holds all
neighbours. Upkeep: hubs come by falling degree; a hub that is still one judges the hubs in its star that nobody judged yet, in the same
order: one with more shared than unshared satellites is given up, and its unshared satellites go to the hub that judged it, or to
the one that took that hub's over in the end. A satellite is shared if another hub's star holds it, or if it is a hub with more than one
neighbour. Equal nodes come by hash, then by id, so that long runs of equal ones don't wait for one another.

Rounds. Everything depends on earlier nodes within two steps only. A node is decided as soon as what may still happen before its turn
can't change the answer: hubs by the least rank of hubs and of undecided nodes around each node, upkeep by bounds on the time at which each
hub may be given up, of which a satellite needs the two latest. The earliest undecided node can always be decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.operators.cover import relevance
from linkweave.plans.lineage import cut

NEVER = (1 << 63) - 1
MOST_ROUNDS = 1000


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``r``: the place from 0 in an order, range by range; only one row a range is put in order in one task."""
    placed = cut(df.sort(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("at")) - 1
    return placed.join(F.broadcast(before), "part").withColumn("r", F.col("before") + nth).drop("part", "at", "before")


def tie(name: str = "node") -> list[Column]:
    return [F.xxhash64(name), F.col(name)]


def star_hubs(cells: DataFrame) -> DataFrame:
    """(node) of the hubs that the first walk makes. Needs both arcs of each edge; loops don't count."""
    arcs = cut(cells.filter("col <> row").select("col", "row").distinct())
    ranked = numbered(relevance(cells), F.desc("relevance"), *tie())
    state = cut(ranked.select("node", "r", F.lit(0).alias("s")))  # 0: open, 1: hub, 2: not
    around = cut(arcs.unionByName(ranked.select(F.col("node").alias("col"), F.col("node").alias("row"))))
    far = F.lit(NEVER)
    for _ in range(MOST_ROUNDS):
        open_ = state.filter("s = 0").select("node", "r")
        if open_.isEmpty():
            return state.filter("s = 1").select("node")
        pairs = around.join(open_.withColumnRenamed("node", "col"), "col")  # open node col of rank r and its surroundings
        first = [F.coalesce(F.min(F.when(F.col("s") == k, F.col("r"))), far).alias(f"first{k}") for k in (0, 1)]
        seen = around.join(state.withColumnRenamed("node", "row"), "row").groupBy(F.col("col").alias("x")).agg(*first)
        told = pairs.join(seen.withColumnRenamed("x", "row"), "row").groupBy(F.col("col").alias("node"), "r").agg(
            F.max((F.col("first1") > F.col("r")) & (F.col("first0") == F.col("r"))).alias("finds"), F.max("first1").alias("last"))
        news = told.select("node", F.when(F.col("finds"), 1).when(F.col("last") < F.col("r"), 2).otherwise(0).alias("t"))
        state = cut(state.join(news, "node", "left").select("node", "r", F.coalesce("t", "s").alias("s")))
    raise RuntimeError("hubs did not settle")


def judged(cells: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second walk: (w, r, degree, kept, time, judge) of the hubs, and (s, w) of what stars hold: satellites, and hubs with
    several neighbours for themselves."""
    arcs = cut(cells.filter("col <> row").select("col", "row").distinct())
    degree = arcs.groupBy(F.col("col").alias("node")).agg(F.count("*").alias("degree"))
    hub = cut(numbered(hubs.join(degree, "node"), F.desc("degree"), *tie()).select(F.col("node").alias("w"), "r", "degree"))
    n = hub.count() + 1
    star = cut(arcs.join(hub.select(F.col("w").alias("col")), "col", "left_semi").select(F.col("col").alias("w"), F.col("row").alias("s")))
    near = cut(star.join(hub.select(F.col("w").alias("s"), F.col("r").alias("rh")), "s").select(F.col("s").alias("h"), "rh", "w"))  # w is in the star of h
    holds = cut(star.select("s", "w").unionByName(hub.filter("degree > 1").select(F.col("w").alias("s"), "w")))
    null = F.lit(None).cast("long")
    state = cut(hub.select("*", F.lit(False).alias("done"), F.lit(True).alias("kept"), null.alias("time"), null.alias("judge")))
    for _ in range(MOST_ROUNDS):
        if state.filter("not done").isEmpty():
            return state.drop("done"), holds
        # a hub can judge unless it was given up before its own turn
        gone = F.col("done") & ~F.col("kept") & (F.col("time") < F.col("r") * n)
        judges = state.filter(~gone).select(F.col("w").alias("h"))
        first = near.join(judges, "h", "left_semi").groupBy("w").agg(F.min(F.struct("rh", "h")).alias("c"))
        now = state.join(first, "w", "left").withColumns({"c": F.when(~F.col("done"), F.col("c"))})
        now = now.withColumn("done", F.col("done") | F.col("c").isNull()).withColumn("time", F.when(F.col("done"), F.col("time")).otherwise(F.col("c.rh") * n + F.col("r")))
        now = cut(now.select("w", "r", "degree", "done", "kept", "time", F.col("c.h").alias("h"), "judge"))  # of undecided hubs: the earliest time
        sure = now.filter(F.when(F.col("done"), F.col("kept") | (F.col("time") > F.col("r") * n)).otherwise(F.col("time") > F.col("r") * n))
        ready = cut(now.filter("not done").join(sure.select(F.col("w").alias("h")), "h", "left_semi").select("w", "time", "degree", "h"))
        late = now.select("w", F.when(F.col("done") & F.col("kept"), NEVER).otherwise(F.col("time")).alias("lo"), F.when(F.col("done") & ~F.col("kept"), F.col("time")).otherwise(NEVER).alias("hi"))
        top = holds.join(star.join(ready.select("w"), "w", "left_semi").select("s").distinct(), "s", "left_semi").join(late, "w")
        top = cut(top)
        best = top.groupBy("s").agg(F.max(F.struct("lo", "w")).alias("l1"), F.max(F.struct("hi", "w")).alias("h1"))
        second = top.join(best, "s").groupBy("s", "l1", "h1").agg(F.max(F.when(F.col("w") != F.col("l1.w"), F.col("lo"))).alias("l2"), F.max(F.when(F.col("w") != F.col("h1.w"), F.col("hi"))).alias("h2"))
        met = star.join(ready.drop("h"), "w").join(second, "s")
        other = lambda k: F.coalesce(F.when(F.col(f"{k}1.w") == F.col("w"), F.col(f"{k}2")).otherwise(F.col(f"{k}1")[{"l": "lo", "h": "hi"}[k]]), F.lit(-1))
        count = met.groupBy("w", "degree").agg(F.count_if(other("l") > F.col("time")).alias("shared"), F.count_if(other("h") < F.col("time")).alias("own"))
        verdict = count.select("w", F.when(2 * F.col("own") >= F.col("degree"), True).when(2 * F.col("shared") > F.col("degree"), False).alias("v")).filter("v is not null")
        out = now.join(verdict, "w", "left")
        state = cut(out.select("w", "r", "degree", (F.col("done") | F.col("v").isNotNull()).alias("done"), F.when(F.col("done"), F.col("kept")).otherwise(F.coalesce("v", F.lit(True))).alias("kept"),
                               F.when(F.col("done") | F.col("v").isNotNull(), F.col("time")).alias("time"), F.when(F.col("v").isNotNull(), F.col("h")).otherwise(F.col("judge")).alias("judge")))
    raise RuntimeError("hubs were not all judged")


def star_cover(cells: DataFrame) -> DataFrame:
    """membership(cluster, node): the stars after both walks; a cluster is named by its hub."""
    hubs, holds = judged(cells, star_hubs(cells))
    kept = cut(hubs.filter("kept").select("w"))
    given_up = cut(hubs.filter("not kept").select("w", "time", "judge"))
    late = hubs.select(F.col("w").alias("o"), F.when(F.col("kept"), NEVER).otherwise(F.col("time")).alias("until"))
    mine = given_up.join(holds.filter("s <> w"), "w")
    others = holds.withColumnRenamed("w", "o").join(mine.select("s").distinct(), "s", "left_semi").join(late, "o")
    last = others.groupBy("s").agg(F.max(F.struct("until", "o")).alias("a"))
    second = others.join(last, "s").groupBy("s", "a").agg(F.max(F.when(F.col("o") != F.col("a.o"), F.col("until"))).alias("b"))
    until = F.coalesce(F.when(F.col("a.o") == F.col("w"), F.col("b")).otherwise(F.col("a.until")), F.lit(-1))
    loose = mine.join(second, "s").filter(until < F.col("time")).select("s", F.col("judge").alias("w"))
    linked, done = cut(loose), None
    for _ in range(MOST_ROUNDS):  # hubs that took over may have been given up later
        home = linked.join(kept, "w", "left_semi")
        done = home if done is None else done.unionByName(home)
        rest = linked.join(given_up.drop("time"), "w").select("s", F.col("judge").alias("w"))
        linked, done = cut(rest), cut(done)
        if linked.isEmpty():
            break
    whole = holds.join(kept, "w", "left_semi").unionByName(kept.select(F.col("w").alias("s"), "w")).unionByName(done)
    return whole.select(F.col("w").alias("cluster"), F.col("s").alias("node")).distinct()
