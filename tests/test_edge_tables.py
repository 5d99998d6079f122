import pytest
from edges import empty_folder, null_folder

from morphloom.plans import catalog


@pytest.fixture(scope="module")
def empty(folder, tmp_path_factory):
    return empty_folder(folder, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(folder, tmp_path_factory):
    return null_folder(folder, tmp_path_factory.mktemp("nulls"))


def test_queries_on_empty_tables(spark, empty):
    for name, query in catalog.QUERIES.items():
        if name not in ("bpe_merges", "em_gloss", "carved_words", "cotrained_roots", "ledger_stream"):
            assert query(spark, empty).count() in (0, 1), name


def test_queries_on_nulls_and_repeats(spark, nulls):
    for name, query in catalog.QUERIES.items():
        if name not in ("bpe_merges", "em_gloss", "carved_words", "cotrained_roots", "ledger_stream"):
            assert query(spark, nulls).count() >= 0, name
