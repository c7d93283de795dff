"""Operators on generated towns against what was planted in them."""

import pytest
from conftest import DATA, rows_of

from terrane.plans import towns, twin

QUERIES, ORACLE = towns.QUERIES | twin.TOWN_QUERIES, towns.ORACLE | twin.TOWN_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_towns(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_generated_scenes_repeat(spark):
    one, two = (sorted(map(repr, towns.synthetic_scene(spark, DATA).collect())) for _ in range(2))
    assert one == two and one
