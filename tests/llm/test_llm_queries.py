import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from same import assert_same  # noqa: E402

from morphloom.llm import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    assert_same(catalog.QUERIES[name](spark, folder), duck.sql(catalog.SQL[name]))


def test_every_document_has_its_ids(spark, folder):
    got = catalog.QUERIES["p6_ids"](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_split_documents_are_those_above_the_capacity(spark, folder):
    counts = catalog.QUERIES["p6_ids"](spark, folder).filter("size(ids) > 4096").select("doc_id")
    got = catalog.QUERIES["p7_found"](spark, folder)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in counts.collect())


def test_rates_cover_every_source(spark, folder):
    rates = catalog.QUERIES["p8_rates"](spark, folder).collect()
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert sum(r.documents for r in rates) == documents.count() and len(rates) == documents.select("source").distinct().count()
    assert all(0 <= r.rate <= 1 for r in rates)
