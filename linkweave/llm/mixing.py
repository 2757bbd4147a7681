"""Mixing sources to target weights: hierarchical token budgeting and seeded epochs.

Documents hang in a tree domain -> language -> source. Integer weights stand at each level (1 unless given). The token
budget goes down the tree by water-filling: children share their parent's budget by weight, a child that holds too
few tokens (its tokens times ``max_epochs``) is filled up and what it leaves goes to its siblings; only when all
siblings are full the shortage reaches the parent's siblings. A leaf's share is a prefix of its documents' token
stream over seeded epochs: whole epochs first, then a token prefix of the next epoch's order (md5 of seed, epoch and
doc_id).

The prefix is found without sorting a leaf in one task: token sums per (leaf, hash bucket) locate the bucket in which
the prefix ends, and only that bucket's documents are ordered. Everything is DataFrame code.

Null text counts no tokens and is never selected; null lang and source are leaves of their own (``und``, ``none``);
rows that repeat a doc_id within a leaf share one place in the order, and a cut there is shared in proportion. A token
is a maximal run without ASCII white space. Token totals times weights must stay under 2**63.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.llm.common import cut

LEVELS = ["domain", "lang", "source"]
#: Leaf tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 10_000


@dataclass(frozen=True)
class MixPlan:
    """Budget in percent of all tokens, repeat limit, seed and weights per level (missing names weigh 1)."""

    budget_percent: int = 80
    max_epochs: int = 3
    seed: int = 17
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}})


def domain_of(source: Column) -> Column:
    """The given tables have no domain column: four domains by the first hex digit of md5(source)."""
    return F.concat(F.lit("d"), F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) / 4).cast("string"))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def with_leaf(docs: DataFrame) -> DataFrame:
    """Adds the leaf columns mix_domain, mix_lang, mix_source and mix_tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    return docs.withColumns({"mix_domain": domain_of(source), "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("und")), "mix_source": source, "mix_tokens": token_count(F.col("text"))})


def weight_of(level: str, plan: MixPlan) -> Column:
    given = plan.weights.get(level) or {}
    if not given:
        return F.lit(1).cast("long")
    if any(int(v) != v or v < 1 for v in given.values()):
        raise ValueError("weights are integers of 1 or more")
    known = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    return F.coalesce(F.try_element_at(known, F.col(level)), F.lit(1).cast("long"))


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares ``budget`` (the parent's) among siblings by ``weight`` up to ``cap``; adds ``share``.

    Siblings are taken by the ratio cap/weight; one is full while filling it leaves the heavier ratios at least as
    much per weight. All products are integers, so the result does not depend on rounding.
    """
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = family.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name)).rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.withColumns({"cap_to": F.sum("cap").over(order), "w_to": F.sum("weight").over(order), "w_all": F.sum("weight").over(family)})
    full = F.col("cap") * (F.col("w_all") - F.col("w_to")) <= (F.col("budget") - F.col("cap_to")) * F.col("weight")
    nodes = nodes.withColumn("full", (F.col("cap_to") <= F.col("budget")) & full)
    nodes = nodes.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family), "w_full": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(family)})
    rest = F.expr("(budget - cap_full) * weight div nullif(w_all - w_full, 0)")
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.coalesce(rest, F.lit(0)), F.col("cap")))).drop("cap_to", "w_to", "w_all", "full", "cap_full", "w_full")


def budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): its share of the budget. One row per leaf throughout."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    budget = F.lit(total * plan.budget_percent // 100).cast("long")
    given = None
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(level, plan))
        nodes = nodes.withColumn("budget", budget) if given is None else nodes.join(given, path[:-1])
        given = fill(nodes, path[:-1], level).select(*path, *(["tokens"] if depth == 2 else []), F.col("share").alias("budget"))
    return given.withColumnRenamed("budget", "share")


def place(epoch: Column, doc_id: Column, plan: MixPlan) -> Column:
    """A document's place in a leaf's epoch: an md5 that depends on seed, epoch and doc_id."""
    return F.md5(F.concat(F.lit(f"{plan.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(tokens: DataFrame, plan: MixPlan) -> DataFrame:
    """Per leaf: epochs (whole ones), cut_place and cut_tokens (of the document at which the prefix ends), unit_tokens.

    ``tokens``: doc_id, domain, lang, source, n_tokens. Places before the cut are taken whole in the last epoch.
    """
    leaves = cut(budgets(tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan))
    leaves = leaves.withColumns({"epochs": F.coalesce(F.expr("share div nullif(tokens, 0)"), F.lit(0).cast("long"))})
    leaves = leaves.withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    placed = with_small(tokens, leaves.select(*LEVELS, "epochs", "rest"), LEVELS).filter("n_tokens > 0")
    placed = placed.withColumn("place", place(F.col("epochs"), F.col("doc_id"), plan)).withColumn("bucket", F.substring("place", 1, 3))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = sums.filter("before <= rest and rest < before + n").select(*LEVELS, "bucket", "before")
    units = with_small(placed, last, [*LEVELS, "bucket"], "inner").groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("unit_tokens"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    within = W.partitionBy(*LEVELS).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    units = units.withColumn("to_here", F.col("before") + F.coalesce(F.sum("unit_tokens").over(within), F.lit(0)))
    ends = units.filter("to_here <= rest and rest < to_here + unit_tokens").select(*LEVELS, F.col("place").alias("cut_place"), (F.col("rest") - F.col("to_here")).alias("cut_tokens"), "unit_tokens")
    return leaves.join(ends, LEVELS, "left").select(*LEVELS, "share", "epochs", "cut_place", "cut_tokens", "unit_tokens")


def with_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a per-leaf table: broadcast when a count shows that it is small, else by shuffle."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else small, keys, how)


def taken(n_tokens: str, doc_id: str, plan: MixPlan) -> dict[str, Column]:
    """epochs and part_tokens of a document whose leaf's cut has been joined."""
    at = place(F.col("epochs"), F.col(doc_id), plan)
    part = F.when(F.col("cut_place").isNull(), 0).when(at < F.col("cut_place"), F.col(n_tokens))
    part = part.when(at == F.col("cut_place"), F.expr(f"cut_tokens * {n_tokens} div unit_tokens")).otherwise(0)
    return {"part_tokens": F.coalesce(part, F.lit(0)).cast("long")}


def token_table(docs: DataFrame) -> DataFrame:
    return with_leaf(docs).select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"))


def mix_documents(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """Per document: leaf, n_tokens, epochs (times taken whole), part_tokens (of the last epoch) and taken_tokens."""
    plan = plan or MixPlan()
    tokens = cut(token_table(docs))
    out = with_small(tokens, cut(cuts(tokens, plan)), LEVELS)
    out = out.withColumns(taken("n_tokens", "doc_id", plan))
    epochs = F.when(F.col("n_tokens") > 0, F.col("epochs")).otherwise(0).cast("long")
    return out.select("doc_id", *LEVELS, "n_tokens", epochs.alias("epochs"), "part_tokens", (epochs * F.col("n_tokens") + F.col("part_tokens")).alias("taken_tokens"))


def mixed_corpus(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """The mixed documents themselves: the input's columns, one row per epoch that takes the document.

    A document at which a leaf's prefix ends keeps its first tokens only (its n_chars follows, where there is one).
    """
    plan = plan or MixPlan()
    tokens = cut(token_table(docs))
    leaf = {"domain": "mix_domain", "lang": "mix_lang", "source": "mix_source"}
    ends = cut(cuts(tokens, plan)).withColumnsRenamed(leaf)
    whole = with_leaf(docs).select(F.struct(*docs.columns).alias("row"), "doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens")
    out = with_small(whole, ends, list(leaf.values())).withColumns(taken("mix_tokens", "doc_id", plan))
    out = out.filter((F.col("mix_tokens") > 0) & ((F.col("epochs") > 0) | (F.col("part_tokens") > 0)))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("part_tokens") > 0, 0).otherwise(1))))
    short = (F.col("copy") == F.col("epochs")) & (F.col("part_tokens") < F.col("mix_tokens"))
    head = F.array_join(F.slice(F.split("row.text", "(?<=[^ \\t\\n\\x0B\\f\\r])(?=[ \\t\\n\\x0B\\f\\r])"), F.lit(1), F.col("part_tokens").cast("int")), "")
    out = out.withColumn("text", F.when(short, head).otherwise(F.col("row.text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, 'd' || CAST(CAST(floor((instr('0123456789abcdef', substr(md5(coalesce(source,'none')),1,1)) - 1) / 4) AS BIGINT) AS VARCHAR) AS domain,
  coalesce(lang,'und') AS lang, coalesce(source,'none') AS source, CAST(len(regexp_extract_all(coalesce(text,''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 3 AS BIGINT) AS cap FROM t GROUP BY ALL),
d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w, (SELECT CAST(sum(tokens) AS BIGINT) * 80 // 100 FROM l) AS b FROM l GROUP BY domain),
d1 AS (SELECT *, sum(cap) OVER o AS ct, sum(w) OVER o AS wt, sum(w) OVER () AS wa FROM d0 WINDOW o AS (ORDER BY cap / w, domain ROWS UNBOUNDED PRECEDING)),
d2 AS (SELECT *, (ct <= b AND cap * (wa - wt) <= (b - ct) * w) AS f FROM d1),
d3 AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER () AS cf, sum(CASE WHEN f THEN w ELSE 0 END) OVER () AS wf FROM d2),
d4 AS (SELECT domain, CASE WHEN f THEN cap ELSE least((b - cf) * w // nullif(wa - wf, 0), cap) END AS b FROM d3),
g0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(d4.b) AS b FROM l JOIN d4 USING (domain) GROUP BY domain, lang),
g1 AS (SELECT *, sum(cap) OVER o AS ct, sum(w) OVER o AS wt, sum(w) OVER (PARTITION BY domain) AS wa FROM g0 WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang ROWS UNBOUNDED PRECEDING)),
g2 AS (SELECT *, (ct <= b AND cap * (wa - wt) <= (b - ct) * w) AS f FROM g1),
g3 AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER p AS cf, sum(CASE WHEN f THEN w ELSE 0 END) OVER p AS wf FROM g2 WINDOW p AS (PARTITION BY domain)),
g4 AS (SELECT domain, lang, CASE WHEN f THEN cap ELSE least((b - cf) * w // nullif(wa - wf, 0), cap) END AS b FROM g3),
s0 AS (SELECT l.*, 1 AS w, g4.b AS b FROM l JOIN g4 USING (domain, lang)),
s1 AS (SELECT *, sum(cap) OVER o AS ct, sum(w) OVER o AS wt, sum(w) OVER (PARTITION BY domain, lang) AS wa FROM s0 WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, (ct <= b AND cap * (wa - wt) <= (b - ct) * w) AS f FROM s1),
s3 AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER p AS cf, sum(CASE WHEN f THEN w ELSE 0 END) OVER p AS wf FROM s2 WINDOW p AS (PARTITION BY domain, lang)),
s4 AS (SELECT domain, lang, source, tokens, CASE WHEN f THEN cap ELSE least((b - cf) * w // nullif(wa - wf, 0), cap) END AS share FROM s3),
s5 AS (SELECT *, coalesce(share // nullif(tokens, 0), 0) AS e FROM s4),
p AS (SELECT t.*, e, share - e * tokens AS rest, md5('17:' || CAST(CAST(e AS BIGINT) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS place FROM t JOIN s5 USING (domain, lang, source)),
u AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM p)
SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens > 0 THEN e ELSE 0 END AS BIGINT) AS epochs,
  CAST(greatest(0, least(n_tokens, rest - bef)) AS BIGINT) AS part_tokens,
  CAST(CASE WHEN n_tokens > 0 THEN e ELSE 0 END * n_tokens + greatest(0, least(n_tokens, rest - bef)) AS BIGINT) AS taken_tokens FROM u
"""
