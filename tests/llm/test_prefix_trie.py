"""The prefix trie against one built from whole texts, and SQL."""

import hashlib
import random
import re
import zlib

import pytest

from linkweave.llm import prefix_trie as P
from tests.conftest import TINY, duck_rows, rows_of

SCHEMA = "conv_id long, turn long, role string, text string, depth long, h1 string, words string, n long"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    """The contract, with rebuilt texts."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = {}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], sha([c for c in m if len(whole[c]) == len(node)])) for node, m in members.items()), key=repr)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed=3, n=130):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
    rows = [(c, t, rng.choice(["user", "bot"]), text()) for c in range(n) if c != 40 for t in range(rng.choice([1, 1, 2, 4, 7]))]
    rows += [(c, t, "user", "same thing") for c in range(200, 260) for t in range(5)]  # a large group of copies
    rows += [(300, t, "user", f"turn {t}") for t in range(400)] + [(301, t, "user", f"turn {t}") for t in range(399)]  # long ones
    odd = [(None, 0, "user", "x"), (61, None, None, None), (61, None, "user", ""), (61, 0, "user", "b"), (61, 0, "user", "b"), (61, 0, "bot", "b"), (-15, 0, "user", "a\x0bb  c"), (-20, 3, "a", "bc"), (-3, 3, "ab", "c"), (2**60 + 1, -1, "user", "a b"), (500, 0, "user", "word " * 20_000)]
    return rows + odd


@pytest.mark.parametrize("share, chunk", [(1000, 4096), (5, 3)])
def test_trie_matches_whole_texts(spark, monkeypatch, share, chunk):
    monkeypatch.setattr(P, "SHARE", share)
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = conversations()
    assert told(P.prefix_trie(made(spark, rows))) == brute(rows)


def test_colliding_hashes_are_found(spark, monkeypatch):
    rows = conversations(5, 30)
    monkeypatch.setattr(P, "SCHEMES", (P.Scheme(1, bits=2), P.Scheme(2, modulus=11), P.Scheme(3)))
    assert told(P.prefix_trie(made(spark, rows))) == brute(rows)
    monkeypatch.setattr(P, "SCHEMES", P.SCHEMES[:2])
    with pytest.raises(RuntimeError):
        P.prefix_trie(made(spark, rows))


def test_nothing_and_turnless(spark):
    none = made(spark, conversations()).limit(0)
    assert told(P.prefix_trie(none)) == []
    rows = [(c, 0, "user", "x") for c in (41, 42, 43, 45)]  # some lose their only turn to a base that is not there
    got = told(P.prefix_trie(made(spark, rows)))
    assert got == brute(rows) and any(zlib.crc32(str(c).encode()) % 4 for c in (41, 42, 43, 45))
    rows = [(c, 0, "user", "x") for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4]
    assert told(P.prefix_trie(made(spark, rows))) == brute(rows)


def test_matches_sql(spark):
    names, want = duck_rows(P.ORACLE)
    got = P.prefix_trie(spark.read.parquet(f"{TINY}/conversations.parquet"))
    assert sorted(got.columns) == names and rows_of(got) == want
