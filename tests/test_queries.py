"""Every registered query outside the training-data subpackage against SQL, or at least against rows."""

from __future__ import annotations

import pytest
from oracle import same

from metaloom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, data, name):
    same(spark, plans.QUERIES[name], plans.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
