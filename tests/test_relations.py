"""Every relation against its oracle on the smallest tables."""

import math

import pytest
from conftest import SF

from segq.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "null" if v is None else str(v) if not isinstance(v, int) or isinstance(v, bool) else f"{v:.6g}"


ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(ORACLES):
        assert registry.queries()[name](spark, SF).count() >= 0
