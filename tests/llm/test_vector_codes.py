"""Vector codes and the tree that finds nearest entries, against full searches and SQL."""

import hashlib
import math

import numpy as np
import pytest

from linkweave.llm import gnat, vector_codes as V
from tests.conftest import TINY, duck_rows, rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, e string, total int"


@pytest.mark.parametrize("reach", [3, 1000, 2**24])
def test_nearest_with_ties(reach):
    rng = np.random.default_rng(reach)
    for n in (1, 7, 40, 256):
        points = rng.integers(-reach, reach + 1, (n, 5))
        points[n // 2 :] = points[: n - n // 2]  # every point twice: the lower index wins
        queries = np.concatenate([rng.integers(-reach, reach + 1, (300, 5)), points])
        code, dist = gnat.Gnat(points).nearest(queries)
        want = ((queries[:, None] - points[None]) ** 2).sum(2)
        assert (code == want.argmin(1)).all() and (dist == want.min(1)).all()


def test_tree_meets_few_points_of_clustered_ones():
    rng = np.random.default_rng(4)
    centres = rng.integers(-9000, 9000, (16, 8))
    points, queries = (np.repeat(centres, k, 0) + rng.integers(-60, 60, (16 * k, 8)) for k in (16, 50))
    tree = gnat.Gnat(points)
    code, _ = tree.nearest(queries)
    assert (code == gnat.squares(queries, points).argmin(1)).all()
    assert tree.met < 0.4 * len(queries) * len(points)


def brute(rows):
    """The contract by loops; rows: (vec_id, embedding, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 4)
    parts = []
    for r in kept:
        y = [max(-(2**24), min(2**24, math.floor(1024 * x))) for x in r[1]] + [0] * (4 * width - len(r[1]))
        parts.append([y[p * width : (p + 1) * width] for p in range(4)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:256]
    books = [[parts[i][p] for i in order] for p in range(4)]

    def code(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(4):
        for p in range(4):
            near = [code(x[p], books[p])[1] for x in parts]
            for e in set(near):
                mine = [x[p] for x, k in zip(parts, near) if k == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = [[code(x[p], books[p]) for p in range(4)] for x in parts]
    errors, total = [sum(d for d, _ in g) for g in got], {}
    for r, e in zip(kept, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in g), x, total[r[2]], sha) for r, g, x in zip(kept, got, errors)), key=repr)


def made(n=400):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    odd = [(None, [0.1] * 8, 1), (5000, None, 1), (5001, [0.1, None] * 4, 1), (5002, [float("nan")] + [0.0] * 7, None), (5003, [float("inf")] + [0.0] * 7, 2),
           (5004, [0.5, -0.5, 0.25], 9), (5005, [], None), (3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (5006, [1e30, -1e30] * 4, 2)]
    return rows + odd


@pytest.mark.parametrize("labels", [V.BROADCAST_LABELS, 1])
def test_codes_match_loops(spark, monkeypatch, labels):
    monkeypatch.setattr(V, "BROADCAST_LABELS", labels)
    monkeypatch.setattr(V, "SHARE", 6)
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    got = V.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_and_no_vectors(spark):
    few = made(9)[:9]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in few], SCHEMA)
    assert sorted(map(tuple, V.vector_codes(df).collect()), key=repr) == brute(few)
    for none in (df.limit(0), df.filter("vec_id is null")):
        assert V.vector_codes(none).collect() == []


def test_matches_sql(spark):
    names, want = duck_rows(V.ORACLE)
    got = V.vector_codes(spark.read.parquet(f"{TINY}/embeddings.parquet"))
    assert sorted(got.columns) == names and rows_of(got) == want
