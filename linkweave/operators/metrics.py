"""Scores of clusterings against truth or each other.

Assignments are long tables: truth(obj, class[, support]) and clusters(obj, cluster), many to many unless a measure asks for
partitions. Pair counts come from the contingency table, never from pairs of objects.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.plans.lineage import cut


def contingency(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): objects that the classes of two assignments share."""
    return a.select("obj", x).join(b.select("obj", y), "obj").groupBy(x, y).agg(F.count("*").alias("n"))


def full_crosstab(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """The contingency with zeros for pairs that share nothing; both label sets are small by their role."""
    labels = a.select(x).distinct().join(F.broadcast(b.select(y).distinct()))
    return labels.join(contingency(a, b, x, y), [x, y], "left").select(x, y, F.coalesce("n", F.lit(0)).alias("n"))


def with_sizes(table: DataFrame, x: str, y: str) -> DataFrame:
    """Adds nx, ny: the totals of each cell's row and column."""
    a = table.groupBy(x).agg(F.sum("n").alias("nx"))
    return table.join(a, x).join(table.groupBy(y).agg(F.sum("n").alias("ny")), y)


def hard_assignment(truth: DataFrame) -> DataFrame:
    """Each object's class of greatest support; ties go to the smaller class."""
    best = F.max(F.struct(F.col("support"), (-F.col("class")).alias("c")))
    return truth.groupBy("obj").agg(best.alias("b")).select("obj", (-F.col("b.c")).alias("class"), F.col("b.support").alias("support"))


def label_tally(truth: DataFrame) -> DataFrame:
    """(class, n, share): assignments of each class and their share of all."""
    t = truth.groupBy("class").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def masks(table: DataFrame, label: str, name: str) -> DataFrame:
    """(obj, name): each object's labels as bits of an array of longs, 63 to a word; labels are numbered in order."""
    labels = table.select(label).distinct().withColumn("bit", F.row_number().over(W.orderBy(label)) - 1)
    words = labels.agg(F.coalesce(F.max("bit"), F.lit(0))).first()[0] // 63 + 1
    placed = table.select("obj", label).distinct().join(F.broadcast(labels) if words <= 1_000 else labels, label)
    bit = F.expr("shiftleft(1L, bit % 63)")
    return placed.groupBy("obj").agg(F.array(*[F.coalesce(F.sum(F.when(F.floor(F.col("bit") / 63) == i, bit)), F.lit(0)).cast("long") for i in range(words)]).alias(name))


def shared_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def first_shared(label: str, a: str, b: str, words: int) -> Column:
    """Whether a label's bit is the lowest that two masks share: it names each pair of overlapping masks once."""
    both = [F.get(a, i).bitwiseAND(F.get(b, i)) for i in range(words)]
    at, bit = F.floor(F.col(label) / 63), F.expr(f"shiftleft(1L, {label} % 63)")
    here = [(at == i) & (x.bitwiseAND(-x) == bit) & F.forall(F.array(*both[:i], F.lit(0).cast("long")), lambda v: v == 0) for i, x in enumerate(both)]
    out = here[0]
    for h in here[1:]:
        out = out | h
    return out


def bcubed_soft(truth: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: extended B-cubed pre, rec, f over the shared objects, and completeness (shared of all objects).

    An object's precision is the mean, over objects that share a cluster with it, of min(shared classes, shared clusters) /
    shared clusters. Objects of equal class and cluster sets are taken together first. Such signatures meet by their labels,
    each pair only at the first label that it shares, so pairs are neither repeated nor sorted out.
    """
    s = cut(masks(truth, "class", "ts").join(masks(clusters, "cluster", "cs"), "obj").groupBy("ts", "cs").agg(F.count("*").alias("n"), F.min("obj").alias("sig")))
    words = s.agg(F.max(F.size("ts")).alias("ts"), F.max(F.size("cs")).alias("cs")).first()

    def one(own: str, other: str, name: str) -> DataFrame:
        n_words = words[own] or 1
        bits = F.filter(F.sequence(F.lit(0), F.lit(63 * n_words - 1)), lambda i: F.get(own, F.floor(i / 63).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 63)) != 0)
        left = s.select("sig", "n", "ts", "cs", F.explode(bits).alias("label"))
        right = left.select("label", F.col("ts").alias("ts2"), F.col("cs").alias("cs2"), F.col("n").alias("n2"))
        p = left.withColumnRenamed("label", "l").join(right, F.col("l") == F.col("label")).filter(first_shared("l", own, f"{own}2", n_words))
        p = p.select("sig", "n", "n2", shared_bits(own, f"{own}2").alias("a"), shared_bits(other, f"{other}2").alias("b"))
        per = p.groupBy("sig", "n").agg((F.sum(F.least("a", "b") / F.col("a") * F.col("n2")) / F.sum("n2")).alias("m"))
        return per.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias(name))

    both = one("cs", "ts", "pre").join(one("ts", "cs", "rec"))
    ids = truth.select("obj", F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(clusters.select("obj", F.lit(0).alias("t"), F.lit(1).alias("c")))
    done = ids.groupBy("obj").agg(F.max("t").alias("t"), F.max("c").alias("c")).agg((F.sum(F.col("t") * F.col("c")) / F.count("*")).alias("completeness"))
    return both.withColumn("f", 2 * F.col("pre") * F.col("rec") / (F.col("pre") + F.col("rec"))).join(done)


def bcubed_hard(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pre, rec, f of two partitions by sums over the contingency table."""
    s = with_sizes(table, x, y).agg((F.sum(F.col("n") * F.col("n") / F.col("ny")) / F.sum("n")).alias("pre"), (F.sum(F.col("n") * F.col("n") / F.col("nx")) / F.sum("n")).alias("rec"))
    return s.withColumn("f", 2 * F.col("pre") * F.col("rec") / (F.col("pre") + F.col("rec")))


def entropies(table: DataFrame, x: str, y: str, log=F.ln) -> DataFrame:
    """One row: h_x, h_y, h_x_given_y, h_y_given_x, mi of the contingency table (natural logarithms unless told)."""
    n, nx, ny = F.col("n"), F.col("nx"), F.col("ny")
    big = table.agg(F.sum("n").alias("total"))
    s = with_sizes(table, x, y).join(F.broadcast(big))
    p = n / F.col("total")
    out = s.agg((-F.sum(p * log(n / ny))).alias("h_x_given_y"), (-F.sum(p * log(n / nx))).alias("h_y_given_x"), F.sum(p * log(n * F.col("total") / (nx * ny))).alias("mi"))

    def own(k: str, name: str) -> DataFrame:
        t = table.groupBy(k).agg(F.sum("n").alias("n")).join(F.broadcast(big))
        return t.agg((-F.sum(n / F.col("total") * log(n / F.col("total")))).alias(name))

    return out.join(own(x, "h_x")).join(own(y, "h_y"))


def v_measure(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: homogeneity, completeness, v of clusters ``y`` against classes ``x``."""
    e = entropies(table, x, y)
    hom = F.when(F.abs("h_x_given_y") < 1e-15, 1.0).otherwise(1 - F.col("h_x_given_y") / F.nullif("h_x", F.lit(0.0)))
    com = F.when(F.abs("h_y_given_x") < 1e-15, 1.0).otherwise(1 - F.col("h_y_given_x") / F.nullif("h_y", F.lit(0.0)))
    e = e.select(hom.alias("homogeneity"), com.alias("completeness"))
    return e.withColumn("v", 2 * F.col("homogeneity") * F.col("completeness") / F.nullif(F.col("homogeneity") + F.col("completeness"), F.lit(0.0)))


def nmi(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mi, h_x, h_y in bits and nmi = 2 mi / (h_x + h_y)."""
    return entropies(table, x, y, F.log2).select("mi", "h_x", "h_y", (2 * F.col("mi") / F.nullif(F.col("h_x") + F.col("h_y"), F.lit(0.0))).alias("nmi"))


def split_join(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: d1, d2: for each class of one side the objects outside its best match on the other."""
    side = lambda k, name: table.groupBy(k).agg((F.sum("n") - F.max("n")).alias("d")).agg(F.sum("d").alias(name))
    return side(x, "d1").join(side(y, "d2"))


def variation_of_information(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the two conditional entropies (natural), not below 0."""
    e = entropies(table, x, y)
    return e.select(F.greatest("h_y_given_x", F.lit(0.0)).alias("d1"), F.greatest("h_x_given_y", F.lit(0.0)).alias("d2"))


def mirkin(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: sums of squared class sizes beyond the squared overlaps, for both sides."""
    sq = lambda k, name: table.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias(name))
    s = sq(x, "a").join(sq(y, "b")).join(table.agg(F.sum(F.col("n") * F.col("n")).alias("ab")))
    return s.select((F.col("a") - F.col("ab")).alias("d1"), (F.col("b") - F.col("ab")).alias("d2"))


def pair_counts(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rand, adjusted_rand and jaccard from numbers of pairs."""
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n")
    side = lambda k, name: table.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs(n)).alias(name))
    s = side(x, "a").join(side(y, "b")).join(table.agg(F.sum(pairs(n)).alias("ab"), pairs(F.sum("n")).alias("all")))
    a, b, ab, total = F.col("a"), F.col("b"), F.col("ab"), F.col("all")
    expected = a * b / total
    return s.select(((total + 2 * ab - a - b) / total).alias("rand"), ((ab - expected) / F.nullif((a + b) / 2 - expected, F.lit(0.0))).alias("adjusted_rand"), (ab / F.nullif(a + b - ab, F.lit(0.0))).alias("jaccard"))


def fowlkes_mallows(truth: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the generalised Fowlkes-Mallows index of overlapping assignments.

    The chance that two objects drawn from D fall into one set of N is N (N - 1) / (D (D - 1)); pairs of sets that overlap
    are counted back. Overlaps come from shared objects.
    """
    t = truth.select("obj", F.col("class").alias("j"))
    c = clusters.select("obj", F.col("cluster").alias("i"))
    pairs = lambda n: F.coalesce(F.sum(F.col(n) * (F.col(n) - 1)), F.lit(0)).cast("double")

    def same(df: DataFrame, k: str, name: str) -> DataFrame:
        one = df.groupBy(k).agg(F.count("*").alias("n")).agg(pairs("n").alias("p"))
        two = df.join(df.withColumnRenamed(k, "k2"), "obj").filter(F.col(k) < F.col("k2")).groupBy(k, "k2").agg(F.count("*").alias("n")).agg(pairs("n").alias("q"))
        return one.join(two).select((F.col("p") - F.col("q")).alias(name))

    tc = t.join(c, "obj")
    one = tc.groupBy("i", "j").agg(F.count("*").alias("n")).agg(pairs("n").alias("p"))
    quad = tc.join(tc.select("obj", F.col("i").alias("i2"), F.col("j").alias("j2")), "obj").filter("i < i2 and j < j2")
    two = quad.groupBy("i", "j", "i2", "j2").agg(F.count("*").alias("n")).agg(pairs("n").alias("q"))
    both = one.join(two).select((F.col("p") - F.col("q")).alias("pc"))
    return both.join(same(t, "j", "pt")).join(same(c, "i", "pk")).select((F.col("pc") / F.sqrt(F.col("pt") * F.col("pk"))).alias("gfm"))


def volatile(table: DataFrame, x: str, y: str, shares: list[float]) -> DataFrame:
    """(share, n): objects in overlaps smaller than that share of both of their classes."""
    s = with_sizes(table, x, y).withColumn("share", F.explode(F.array(*[F.lit(float(f)) for f in shares])))
    weak = (F.col("n") < F.col("share") * F.col("nx")) & (F.col("n") < F.col("share") * F.col("ny"))
    return s.groupBy("share").agg(F.sum(F.when(weak, F.col("n")).otherwise(0)).alias("n"))


def volatility(assignments: list[DataFrame]) -> DataFrame:
    """(obj, score): over all pairs of clusterings, 1 / size of the overlap that holds the object, summed."""
    out = None
    for a, b in itertools.combinations(assignments, 2):
        both = a.select("obj", F.col("cluster").alias("x")).join(b.select("obj", F.col("cluster").alias("y")), "obj")
        n = both.groupBy("x", "y").agg((1 / F.count("*")).alias("s"))
        part = both.join(n, ["x", "y"]).select("obj", "s")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("obj").agg(F.sum("s").alias("score"))


def meet(assignments: list[DataFrame]) -> DataFrame:
    """(obj, part): the common refinement of partitions; a part is named by its smallest object."""
    out, keys = None, []
    for i, a in enumerate(assignments):
        one = a.select("obj", F.col("cluster").alias(f"c{i}"))
        out, keys = (one if out is None else out.join(one, "obj")), [*keys, f"c{i}"]
    return out.join(out.groupBy(*keys).agg(F.min("obj").alias("part")), keys).select("obj", "part")


def mate(table: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, meet, xdiff, ydiff, score): overlapping classes with score 2 meet / (nx + ny)."""
    s = with_sizes(table, x, y)
    return s.select(x, y, F.col("n").alias("meet"), (F.col("nx") - F.col("n")).alias("xdiff"), (F.col("ny") - F.col("n")).alias("ydiff"), (2 * F.col("n") / (F.col("nx") + F.col("ny"))).alias("score"))


def best_match(table: DataFrame, x: str, y: str, least: int = 1, most: int = 2**31 - 1) -> DataFrame:
    """(y, x, size, f, pre, rec): for each cluster the class of best F; ties go to the smaller class."""
    s = with_sizes(table, x, y).filter(F.col("ny").between(least, most))
    s = s.select(x, y, F.col("ny").alias("size"), (F.col("n") / F.col("ny")).alias("pre"), (F.col("n") / F.col("nx")).alias("rec"), (2 * F.col("n") / (F.col("nx") + F.col("ny"))).alias("f"))
    return s.withColumn("r", F.row_number().over(W.partitionBy(y).orderBy(F.desc("f"), x))).filter("r = 1").select(y, x, "size", "f", "pre", "rec")


def ln_factorial(n: Column) -> Column:
    """ln n! for whole n."""

    @F.pandas_udf("double")
    def of(n: pd.Series) -> pd.Series:
        return pd.Series([math.lgamma(x + 1) for x in n.tolist()], dtype="float64")

    return of(n)


def hypergeometric_score(table: DataFrame, x: str, y: str) -> DataFrame:
    """(y, x, score): for each cluster the class of largest -log10 chance of its overlap under random draws."""
    total = int(table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"])
    s = with_sizes(table, x, y)
    lf = ln_factorial
    binom = lambda n, k: lf(n) - lf(k) - lf(n - k)
    big, n, nx, ny = F.lit(total), F.col("n"), F.col("nx"), F.col("ny")
    score = (binom(big, ny) - binom(nx, n) - binom(big - nx, ny - n)) / F.ln(F.lit(10.0))
    return s.withColumn("score", score).withColumn("r", F.row_number().over(W.partitionBy(y).orderBy(F.desc(F.round("score", 9)), x))).filter("r = 1").select(y, x, "score")


#: Contingency tables up to this many labels a side are matched on the driver.
MATCH_LABELS = 2_000


def hungarian(cost: np.ndarray) -> np.ndarray:
    """For each row its column in the matching of least cost (square matrix), by shortest augmenting paths."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]] = reduced[better]
            way[free[better]] = j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def matched_f1(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: macro pre, rec, f1 after matching clusters to classes one to one for the greatest overlap.

    The aggregated contingency table comes to the driver; both label sets must be within MATCH_LABELS.
    """
    spark = table.sparkSession
    rows = table.limit(MATCH_LABELS**2 + 1).collect()
    xs, ys = sorted({r[x] for r in rows}), sorted({r[y] for r in rows})
    size = max(len(xs), len(ys), 1)
    if size > MATCH_LABELS:
        raise ValueError("too many labels to match")
    m = np.zeros((size, size))
    for r in rows:
        m[xs.index(r[x]), ys.index(r[y])] = r["n"]
    m = m[:, hungarian(-m)]
    tp = np.diag(m)
    fn, fp = m.sum(axis=1) - tp, m.sum(axis=0) - tp
    pre, rec = float(tp.mean() / max((tp + fp).mean(), 1e-300)), float(tp.mean() / max((tp + fn).mean(), 1e-300))
    return spark.createDataFrame([(pre, rec, 2 * pre * rec / max(pre + rec, 1e-300))], "pre double, rec double, f1 double")
