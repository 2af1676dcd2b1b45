import math

import pytest
from conftest import SF

from quarry.operators import registry


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in rows), key=str)
    expected = sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=str)
    assert len(got) == len(expected)
    assert all(same(x, y) for g, e in zip(got, expected, strict=True) for x, y in zip(g, e, strict=True))
