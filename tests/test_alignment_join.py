"""Joined alignment blocks against a walk column by column, and their odd cases."""

import random

import pytest

from linkweave.operators import alignment_join as A

SCHEMA = "id long, rows array<struct<chr:string,beg:long,end:long,strand:string,size:long,seq:string>>, probs array<string>"


def blocks(rng, genome, name, n, first):
    out = []
    for i in range(n):
        beg = rng.randrange(0, 150)
        end = beg + rng.randrange(1, 50)
        top = "".join("-" * max(0, rng.randrange(-4, 4)) + c for c in genome[beg:end]) + "-" * rng.randrange(2)
        second = "".join(rng.choice("ACGT-") for _ in top)
        size = len(second.replace("-", ""))
        rows = [("g", beg, end, "+", 200, top), (f"{name}{i}", 7, 7 + size, "-", 99, second)]
        out.append((first + i, rows, ["".join(rng.choice("012") for _ in top)]))
    return out


def brute(a, b):
    """Columns keyed by the place of the letter that they stand before, and their number among the gaps there."""
    low, high = max(a[1][0][1], b[1][0][1]), min(a[1][0][2], b[1][0][2])
    if low >= high:
        return None

    def keyed(block):
        at, k, keys = block[1][0][1], 0, []
        for c in block[1][0][5]:
            keys.append((at, k if c == "-" else 10**6))
            at, k = (at, k + 1) if c == "-" else (at + 1, 0)
        inside = [j for j, key in enumerate(keys) if low <= key[0] < high and not (key[0] == low and key[1] < 10**6)]
        return {keys[j]: j for j in inside}

    ka, kb = keyed(a), keyed(b)
    every = sorted(set(ka) | set(kb))
    rows, probs = [], []
    for block, key, skip in ((a, ka, 0), (b, kb, 1)):
        for r in block[1][skip:]:
            before = sum(c != "-" for c in r[5][: min(key.values())])
            seq = "".join(r[5][key[e]] if e in key else "-" for e in every)
            rows.append((r[0], r[1] + before, r[1] + before + sum(c != "-" for c in seq), r[3], r[4], seq))
        probs += ["".join(p[key[e]] if e in key else "~" for e in every) for p in block[2]]
    return rows, probs


@pytest.mark.parametrize("bucket", [10_000, 16])
def test_matches_columns(spark, bucket):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(200))
    a, b = blocks(rng, genome, "a", 12, 0), blocks(rng, genome, "b", 12, 100)
    got = A.join_alignments(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), bucket).collect()
    want = {(x[0], y[0]): brute(x, y) for x in a for y in b if brute(x, y)}
    assert {(r["a_id"], r["b_id"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert ([tuple(x) for x in r["rows"]], r["probs"]) == want[r["a_id"], r["b_id"]]


def test_three_sets_one_by_one_and_odd_blocks(spark):
    one = [(1, [("g", 0, 4, "+", 9, "AC--GT")], None), (2, [("g", 0, 0, "+", 9, "--")], []), (3, [], None), (4, [("h", 0, 4, "+", 9, "ACGT")], None)]
    two = [(5, [("g", 1, 4, "+", 9, "C-GT"), ("q", 3, 5, "+", 6, "C--A")], ["1234"])]
    three = [(6, [("g", 0, 3, "+", 9, "A-C---G")], ["abcdefg"])]
    one, two, three = (spark.createDataFrame(x, SCHEMA) for x in (one, two, three))
    r = A.join_alignments(one, two)
    assert [(x["a_id"], x["b_id"], [y["seq"] for y in x["rows"]], x["probs"]) for x in r.collect()] == [(1, 5, ["C--GT", "C---A"], ["12~34"])]
    s = A.join_alignments(r.selectExpr("a_id as id", "rows", "probs"), three).collect()
    assert [([tuple(y)[:3] + (y["seq"],) for y in x["rows"]], x["probs"]) for x in s] == [([("g", 1, 3, "C---G"), ("q", 3, 4, "C----")], ["12~~3", "cdefg"])]
    assert A.join_alignments(one.limit(0), two).count() == 0


def test_other_letters_are_refused(spark):
    one, two = (spark.createDataFrame([(1, [("g", 0, 4, "+", 9, s)], None)], SCHEMA) for s in ("ACGT", "ACGA"))
    with pytest.raises(Exception, match="first sequences differ"):
        A.join_alignments(one, two).collect()
