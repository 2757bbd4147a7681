"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that any match must hold whole. The
frequency of those tokens over all urls is counted once; each rule is filed under its rarest token. A url's tokens
then fetch candidate rules from that index and only the candidates' expressions run. Everything stays in built-in
expressions of one projection: no shuffle, no Python.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. Null urls and urls without ``://`` have empty host and path, match nothing and get the method's
verdict ``allow``. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The host/path rules of the query.
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# Host label pairs of link farms, betting, medicine and tracking sites.
FARM_LABELS = [
    ("casino", "win"), ("cheap", "pills"), ("free", "bets"), ("spam", "farm"), ("ads", "track"),
    ("online", "poker"), ("payday", "loan"), ("adult", "dating"), ("click", "bait"), ("warez", "crack"),
]

#: Rules are literals of the plan, so their number is bounded.
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` over host + path; ``tokens``: alphanumeric runs that stand whole in every match."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for ``host`` and its subdomains where the path starts with ``path``."""
    whole = re.findall("[A-Za-z0-9]+", host) + [x for x in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), verdict, host + path)


def label_rule(*words: str) -> Rule:
    """Blocks hosts with a label made of ``words`` joined by hyphens."""
    return Rule(f"^(?:[^/]*\\.)?{'-'.join(map(re.escape, words))}(?:\\.|/|$)", tuple(words), "block")


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [label_rule(*w) for w in FARM_LABELS]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty for null or a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^A-Za-z0-9]+"))


def rarest_tokens(subjects: DataFrame, rules: list[Rule]) -> list[str]:
    """For each rule its literal token that the fewest subjects hold (ties: the first by name).

    Counts cover all rows; only literal tokens are counted, so at most one row per literal comes back.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    known = F.array(*map(F.lit, literals)) if literals else F.array().cast("array<string>")
    counted = subjects.select(F.explode(F.array_intersect("tokens", known)).alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.collect()}
    return [min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules]


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (the longest fitting host rule, else null), verdict, n_candidates.

    ``verdict`` is the rule's; without one it is ``block`` when any pattern rule matches, else ``allow``.
    """
    rules = default_rules() if rules is None else rules
    if not 0 < len(rules) <= MAX_RULES or not all(r.tokens for r in rules):
        raise ValueError("rules must be given, within MAX_RULES, each with a literal token")
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("subject", F.concat("host", "path")).withColumn("tokens", tokens_of(F.col("subject")))
    index: dict[str, list[int]] = {}
    for i, token in enumerate(rarest_tokens(parts, rules)):
        index.setdefault(token, []).append(i + 1)
    filed = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))])
    facts = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(len(r.name or "")).alias("size"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("verdict")) for r in rules])
    fetched = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull()))
    judged = parts.withColumn("candidates", F.transform(fetched, lambda i: F.element_at(facts, i)))
    judged = judged.withColumn("hits", F.filter("candidates", lambda r: F.regexp_like(F.col("subject"), r["pattern"])))
    named = F.array_max(F.transform(F.filter("hits", lambda r: r["size"] > 0), lambda r: F.struct(r["size"], r["name"], r["verdict"])))
    judged = judged.withColumn("best", named)
    method = F.when(F.exists("hits", lambda r: (r["size"] == 0) & (r["verdict"] == "block")), "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.verdict"), method).alias("verdict"),
        F.size("candidates").cast("long").alias("n_candidates"),
    )


ORACLE = (
    "WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url,''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
    "q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p), "
    "r(h, x, v) AS (VALUES " + ", ".join(f"('{h}', '{x}', '{v}')" for h, x, v in HOST_RULES) + "), "
    "c AS (SELECT DISTINCT host, path FROM q), "
    "m AS (SELECT host, path, arg_max(h || x, length(h || x)) AS rule, arg_max(v, length(h || x)) AS v FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY host, path) "
    "SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host || path, '^([^/]*\\.)?(" + "|".join("-".join(w) for w in FARM_LABELS) + ")(\\.|/|$)') THEN 'block' ELSE 'allow' END) AS verdict "
    "FROM q LEFT JOIN m USING (host, path)"
)
