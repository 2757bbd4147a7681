"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from linkweave.queries import ORACLE, QUERIES
from tests.conftest import TINY, duck_rows, rows_of

SLOW = {"bcubed_soft"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, TINY)
    names, expected = duck_rows(ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TINY).limit(5).collect() is not None
