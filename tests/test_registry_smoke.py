"""Every registered (non-MLlib) query runs on the sf0.001 tables with unique, stable column names."""

import pytest

import __spark_entry__ as E
from conftest import SF

ML = ("i04", "i05", "i06", "i07", "i08", "i16", "i17", "g08")
NAMES = sorted(n for n in E.queries() if not n.startswith(ML))


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    assert len(cols) == len(set(cols))
    df.limit(5).collect()
    if name in E.oracle_sql():
        assert all(not c.startswith("__") for c in cols)
