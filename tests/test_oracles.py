"""Every registered query that has SQL gives the same rows on the smallest tables."""

import pytest

from sievework import plans

from .conftest import DATA, plain


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    want = duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = plans.queries()[name](spark, DATA)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_sql_only_for_queries():
    assert set(plans.oracle_sql()) <= set(plans.queries())
