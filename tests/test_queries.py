import pytest
from same import assert_same

from morphloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    assert_same(catalog.QUERIES[name](spark, folder), duck.sql(catalog.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"bpe_merges", "em_gloss"}))
def test_query_runs(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0
