"""Every registered query runs; those with SQL have its values."""

import pytest

from quillstone.plans import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    oracle.same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, oracle.SF).count() > 0


def test_entry_points_work_without_the_corpus_subpackage():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
