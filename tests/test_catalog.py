"""Every query runs; those with SQL give its rows."""

import pandas as pd
import pytest

from millrace.plans import ORACLES, QUERIES
from tests.conftest import SMALL


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert got.columns and got.count() > 0  # held against plain Python in test_brute.py
        return
    got, want = got.toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
