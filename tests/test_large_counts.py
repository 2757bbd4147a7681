"""Scores of contingency tables of many objects."""

import math

from linkweave.operators import metrics


def test_overlap_chances_of_over_a_million_objects(spark):
    n = {(1, 1): 1_500_000, (1, 2): 400_000, (2, 2): 600_000, (2, 1): 7}
    table = spark.createDataFrame([(x, y, k) for (x, y), k in n.items()], "class long, cluster long, n long")
    lf = lambda k: math.lgamma(k + 1)
    choose = lambda a, b: lf(a) - lf(b) - lf(a - b)
    total = sum(n.values())
    nx, ny = ({v: sum(k for key, k in n.items() if key[i] == v) for v in (1, 2)} for i in (0, 1))
    score = {(x, y): (choose(total, ny[y]) - choose(nx[x], k) - choose(total - nx[x], ny[y] - k)) / math.log(10) for (x, y), k in n.items()}
    want = {y: max((1, 2), key=lambda x: score[x, y]) for y in (1, 2)}
    got = metrics.hypergeometric_score(table, "class", "cluster").collect()
    assert {r["cluster"]: r["class"] for r in got} == want
    assert all(math.isclose(r["score"], score[r["class"], r["cluster"]], rel_tol=1e-9) for r in got)
