"""Queries over tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphloom.operators import tickets as op
from morphloom.plans.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every edit, option and impact of the live tickets, typed and raw."""
    return op.ticket_entities(table(spark, folder, "tickets"), table(spark, folder, "raw_tickets"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
