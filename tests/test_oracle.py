"""Every registered query against its DuckDB oracle (or rows-only when it
has none) on the smallest fixture — the local twin of the driver's gate."""

import pytest

import __spark_entry__ as E
from oracle_check import rows_of

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, duck, sf):
    sdf = QUERIES[name](spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        assert sdf.columns
        return
    res = duck.execute(ORACLE[name])
    dnames = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dnames)
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows, 5) == rows_of(dnames, drows, 5)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns
