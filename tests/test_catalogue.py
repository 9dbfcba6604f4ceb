"""Every query of the catalogue gives what its SQL gives."""

import pytest

from lexiflow.plans import catalogue, formats, runs  # noqa: F401 - they register their queries
from lexiflow.plans.registry import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["q16_stale_prune"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(lang,en))" in plan and "text" not in plan
