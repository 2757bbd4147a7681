"""Pairwise similarity of table rows and of sets.

Rows are vectors (id, v array<double>). Pairs are formed chunk against chunk: each pair of chunks meets once, and numpy multiplies them;
what passes the cutoff comes back. Sets are (id, item) tables that meet by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linkweave.plans.lineage import cut

BLOCK_ROWS = 2_048
#: Items of a set that goes through a join with all of them.
LISTED = 32


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centred(rows: DataFrame) -> DataFrame:
    """Vectors minus their mean."""
    m = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return rows.withColumn("m", m).select("id", F.transform("v", lambda x: x - F.col("m")).alias("v"))


def z_scores(rows: DataFrame) -> DataFrame:
    c = centred(rows).withColumn("sd", F.sqrt(dot("v", "v") / F.size("v")))
    return c.select("id", F.transform("v", lambda x: x / F.nullif("sd", F.lit(0.0))).alias("v"))


def ranks(rows: DataFrame) -> DataFrame:
    """Vectors of ranks within each row from 1; ties share the mean of their places. Sorted copies give the places."""
    s = rows.withColumn("s", F.array_sort("v"))
    place = lambda x: F.array_position(F.col("s"), x) + (F.size(F.filter("s", lambda y: y == x)) - 1) / 2
    return s.select("id", F.transform("v", lambda x: place(x).cast("double")).alias("v"))


def chunks(rows: DataFrame, normalise: bool) -> DataFrame:
    """(ids, v, chunk): rows in chunks of up to ``BLOCK_ROWS`` as bytes, numbered by partition and place; written once."""
    if normalise:
        size = F.sqrt(dot("v", "v"))
        rows = rows.withColumn("size", size).select("id", F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).otherwise(F.col("v")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                v = part.column("v").flatten()
                yield pa.RecordBatch.from_pydict({"ids": [np.asarray(part.column("id"), np.int64).tobytes()], "v": [np.asarray(v, np.float64).tobytes()]})

    made = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, "ids binary, v binary")
    return cut(made.withColumn("chunk", F.monotonically_increasing_id()))


def products(rows: DataFrame, least: float, normalise: bool = True) -> DataFrame:
    """(a, b, s), a < b: inner products of rows (scaled to length 1 unless told) with |s| >= least.

    Chunks of rows are written once and each pair of chunks is read from there by the task that multiplies it: nothing is shuffled, so disk grows
    with the rows and only time with their pairs.
    """
    own = chunks(rows, normalise)
    other = own.select(F.col("ids").alias("ids2"), F.col("v").alias("v2"), F.col("chunk").alias("chunk2"))
    pairs = own.hint("shuffle_replicate_nl").join(other, F.col("chunk") <= F.col("chunk2"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, p, ids2, v2, q = (batch.column(c)[i].as_py() for c in ("ids", "v", "chunk", "ids2", "v2", "chunk2"))
                one, two = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64)
                x, y = np.frombuffer(v).reshape(len(one), -1), np.frombuffer(v2).reshape(len(two), -1)
                s = x @ y.T
                j, k = np.nonzero(np.abs(s) >= least)
                a, b, s = one[j], two[k], s[j, k]
                keep = a < b if p == q else np.ones(len(a), bool)
                a, b, s = a[keep], b[keep], s[keep]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "s": s})

    return pairs.mapInArrow(meet, "a long, b long, s double")


def cosine(rows: DataFrame, least: float) -> DataFrame:
    return products(rows, least)


def pearson(rows: DataFrame, least: float) -> DataFrame:
    return products(centred(rows), least)


def spearman(rows: DataFrame, least: float) -> DataFrame:
    return products(centred(ranks(rows)), least)


def inner(rows: DataFrame, least: float) -> DataFrame:
    return products(rows, least, normalise=False)


def skewed_cosine(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, s) for both orders: root of the inner product over the length of ``a``."""
    p = products(rows, 0.0, normalise=False).filter("s > 0")
    size = rows.select("id", F.sqrt(dot("v", "v")).alias("size"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    return both.join(size.withColumnRenamed("id", "a"), "a").select("a", "b", (F.sqrt("s") / F.col("size")).alias("s")).filter(F.col("s") >= least)


def set_pairs(items: DataFrame) -> DataFrame:
    """(a, b, common, na, nb), a < b: pairs of sets (id, item) that share an item.

    Sets of up to ``LISTED`` items take their items along, so a pair is counted where it meets and told at the first item it shares: it is
    shuffled no more. Pairs with a larger set are counted by their rows.
    """
    lists = items.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("own"), F.max(F.col("item").isNull().cast("long")).alias("n")).withColumn("n", F.col("n") + F.size("own"))
    s = lists.select("id", "own", "n", F.explode("own").alias("item"))
    small = F.size("own") <= LISTED
    one, two = (s.filter(small).select(F.col("id").alias(x), F.col("own").alias(f"o{x}"), F.col("n").alias(f"n{x}"), "item") for x in "ab")
    met = one.join(two, "item").filter("a < b").withColumn("both", F.array_intersect("oa", "ob")).filter(F.col("both")[0] == F.col("item"))
    near = met.select("a", "b", F.size("both").cast("long").alias("common"), "na", "nb")
    if s.filter(~small).isEmpty():
        return near
    n = s.select("id", "item", "n", (~small).alias("large"))
    large, other = n.filter("large").drop("large"), n.select(F.col("id").alias("id2"), "item", F.col("n").alias("n2"), F.col("large").alias("large2"))
    met = large.join(other, "item").filter("id <> id2 and (not large2 or id < id2)")
    far = met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.count("*").alias("common"), F.max(F.when(F.col("id") < F.col("id2"), F.col("n")).otherwise(F.col("n2"))).alias("na"), F.max(F.when(F.col("id") < F.col("id2"), F.col("n2")).otherwise(F.col("n"))).alias("nb"))
    return near.unionByName(far)


def set_scores(pairs: DataFrame, items: int | None = None) -> DataFrame:
    """Adds tanimoto, cosine, meet, cover (of the smaller) and hamming (places that differ)."""
    c, a, b = F.col("common"), F.col("na"), F.col("nb")
    return pairs.select("a", "b", (c / (a + b - c)).alias("tanimoto"), (c / F.sqrt(a * b)).alias("cosine"), c.alias("meet"), (c / F.least(a, b)).alias("cover"), (a + b - 2 * c).alias("hamming"))


def subset_fractions(pairs: DataFrame) -> DataFrame:
    """(a, b, meet, diff) for both orders: the shares of ``a`` inside and outside ``b``."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", F.col("nb").alias("na"), F.col("na").alias("nb")))
    return both.select("a", "b", (F.col("common") / F.col("na")).alias("meet"), (1 - F.col("common") / F.col("na")).alias("diff"))


def culled(intervals: DataFrame, limit: int, bucket: int) -> DataFrame:
    """Intervals (id, contig, start, stop, score) that fewer than ``limit`` better ones of the contig contain.

    A container covers an interval's start, so both meet in the start's bucket.
    """
    wide = intervals.select("contig", F.col("id").alias("i2"), F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("score").alias("x2")).withColumn("b", F.explode(F.expr(f"sequence(s2 div {bucket}, e2 div {bucket})")))
    small = intervals.withColumn("b", F.expr(f"start div {bucket}"))
    over = small.join(wide, ["contig", "b"]).filter("s2 <= start and stop <= e2 and x2 > score").groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
    return intervals.join(over, "id", "left_anti")


