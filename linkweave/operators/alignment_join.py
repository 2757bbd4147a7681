"""Alignment blocks joined on their first sequence: (id, rows, probs), where rows are structs (chr, beg, end, strand, size, seq), all
sequences of a block of one length with ``-`` for gaps, and probs quality lines of that length.

Blocks of two sets meet if their first rows overlap. Only ids and intervals go through the join by bins; sequences come back by id, so a long
block's text isn't repeated for each bin. A pair is cut to the overlap, gaps are added before letters of the first sequence so that its letters
line up, and the second set's further rows follow the first one's. Letters are told by arrays of columns: time grows with the block's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkweave.operators import bins as B

GAP, NO_PROB = "-", "~"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, though f's lambdas use it again and again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def letters(seq: Column) -> Column:
    """The columns (from 0) of a sequence's letters."""
    place = F.transform(F.split(seq, ""), lambda c, i: F.when(c != GAP, i))
    return F.filter(place, lambda i: i.isNotNull())


def kept(rows: Column, low: Column, high: Column) -> Column:
    """Of the first row's letters from low to high (exclusive): struct(p, g), the letter's column and how many gaps stand before it; none before the first."""
    top = rows[0]

    def body(p: Column) -> Column:
        before = F.concat(F.array(p[0] - 1), F.slice(p, 1, F.size(p) - 1))
        return F.zip_with(p, before, lambda a, b: F.struct(a.alias("p"), (a - b - 1).alias("g")))

    return let(F.slice(letters(top["seq"]), (low - top["beg"] + 1).cast("int"), (high - low).cast("int")), body)


def spread(text: Column, plan: Column, gap: str) -> Column:
    """The columns of a text that a plan (p, g, more) names, with ``more`` gaps before each letter of the first row."""
    piece = lambda c, s: F.concat(F.slice(c, s["p"] - s["g"] + 1, s["g"]), F.array_repeat(F.lit(gap), s["more"]), F.array(F.get(c, s["p"])))
    return let(F.split(text, ""), lambda c: F.array_join(F.flatten(F.transform(plan, lambda s: piece(c, s))), ""))


def cut_rows(rows: Column, plan: Column) -> Column:
    """Rows with their sequences spread and their coordinates cut by the letters that go."""
    count = lambda s: F.length(F.translate(s, GAP, "")).cast("long")

    def row(r: Column, first: Column, last: Column, s: Column) -> Column:
        beg, end = r["beg"] + count(F.substring(r["seq"], F.lit(1), first)), r["end"] - count(F.substr(r["seq"], last + 2))
        return F.struct(r["chr"].alias("chr"), beg.alias("beg"), end.alias("end"), r["strand"].alias("strand"), r["size"].alias("size"), spread(r["seq"], s, GAP).alias("seq"))

    return let(plan, lambda s: F.transform(rows, lambda r: row(r, s[0]["p"], F.element_at(s, -1)["p"], s)))


def join_alignments(a: DataFrame, b: DataFrame, bucket: int = 10_000) -> DataFrame:
    """(a_id, b_id, rows, probs): each pair of blocks that overlap in the first row, joined; an error where the first rows' letters differ.

    Ids must be unique within a set. Blocks without rows or without letters in the first one meet nothing. More sets are joined one by one.
    """
    spans = lambda x: x.filter("size(rows) > 0 and rows[0].end > rows[0].beg").select("id", F.expr("rows[0].chr").alias("contig"), F.expr("rows[0].beg").alias("start"), F.expr("rows[0].end - 1").alias("stop"))
    pairs = B.overlapping(spans(a), spans(b), bucket).select("a_id", "b_id")
    side = lambda x, n: x.select(F.col("id").alias(f"{n}_id"), F.col("rows").alias(f"{n}_rows"), F.coalesce("probs", F.array().cast("array<string>")).alias(f"{n}_probs"))
    met = pairs.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    low, high = F.expr("greatest(a_rows[0].beg, b_rows[0].beg)"), F.expr("least(a_rows[0].end, b_rows[0].end)")
    met = met.withColumns({"one": kept(F.col("a_rows"), low, high), "two": kept(F.col("b_rows"), low, high)})
    more = lambda own, other: F.zip_with(own, other, lambda x, y: F.struct(x["p"].alias("p"), x["g"].alias("g"), F.greatest(y["g"] - x["g"], F.lit(0)).alias("more")))
    met = met.withColumns({"one": more(F.col("one"), F.col("two")), "two": more(F.col("two"), F.col("one"))})
    met = met.withColumns({"x": cut_rows(F.col("a_rows"), F.col("one")), "y": cut_rows(F.col("b_rows"), F.col("two"))})
    same = F.expr("x[0].seq = y[0].seq and x[0].strand <=> y[0].strand and x[0].size <=> y[0].size")
    rows = F.when(same, F.expr("concat(x, slice(y, 2, size(y)))")).otherwise(F.raise_error(F.lit("first sequences differ")).cast(a.schema["rows"].dataType))
    lines = lambda n, plan: let(F.col(plan), lambda s: F.transform(f"{n}_probs", lambda t: spread(t, s, NO_PROB)))
    return met.select("a_id", "b_id", rows.alias("rows"), F.concat(lines("a", "one"), lines("b", "two")).alias("probs"))
