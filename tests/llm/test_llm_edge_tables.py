import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edges import empty_folder, null_folder  # noqa: E402

from morphloom.llm import catalog  # noqa: E402


def test_queries_on_empty_tables(spark, folder, tmp_path):
    where = empty_folder(folder, tmp_path)
    for name, query in catalog.QUERIES.items():
        assert query(spark, where).count() == (1 if name == "p7_fill" else 0), name


def test_queries_on_nulls_and_repeats(spark, folder, tmp_path):
    where = null_folder(folder, tmp_path)
    documents = spark.read.parquet(f"{where}/documents.parquet").count()
    for name, query in catalog.QUERIES.items():
        got = query(spark, where).count()
        assert got == documents if name in ("p6_ids", "p8_scores") else got >= 0, name
