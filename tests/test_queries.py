"""Every registered query gives what its SQL gives; those without SQL are checked by their own tests below."""

import pytest

from ledgerline.plans import registry

from .compare import rows, tables

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = tables(sf_dir).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_rest_runs(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(SQL)):
        QUERIES[name](spark, sf_dir).count()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
