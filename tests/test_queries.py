"""Every query with SQL against DuckDB; the others give the same rows twice."""

import pytest
from conftest import DATA, rows_of

from terrane import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_repeats(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    one, two = (sorted(map(repr, catalog.QUERIES[name](spark, DATA).collect())) for _ in range(2))
    assert one == two and (one or name == "bridge_gaps") and len(set(df.columns)) == len(df.columns)
