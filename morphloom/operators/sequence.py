"""Neighbours in sequences: votes of adjacent words, contexts, gaps, word order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, row: list[str], position: str, word: str, keep: Column | None = None, start: str = "<s>") -> DataFrame:
    """``df`` with columns before and after: the neighbouring words in the row.

    keep: rows that count at all. They are filtered first, so that neighbours are
    those of the shortened sequence. before is ``start`` at the beginning, after
    is null at the end.
    """
    kept = df if keep is None else df.filter(keep)
    order = Window.partitionBy(*row).orderBy(position)
    return kept.withColumn("before", F.lag(word, 1, start).over(order)).withColumn("after", F.lead(word).over(order))


def adjacent_votes(df: DataFrame, row: list[str], position: str, word: str, first: Column, second: Column, keep: Column | None = None) -> DataFrame:
    """(first, second, n): how often a value of the word is followed by a value of the next; null values do not vote.

    second is an expression over column ``after``.
    """
    return neighbours(df, row, position, word, keep).select(first.alias("first"), second.alias("second")).dropna().groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def context(df: DataFrame, row: list[str], position: str, word: str, width: int = 2) -> DataFrame:
    """``df`` with arrays left and right: up to ``width`` words on either side."""
    order = Window.partitionBy(*row).orderBy(position)
    return df.withColumn("left", F.collect_list(word).over(order.rowsBetween(-width, -1))).withColumn("right", F.collect_list(word).over(order.rowsBetween(1, width)))


def boundary_gaps(df: DataFrame, row: list[str], start: str, end: str, ceiling: float = 0.5) -> DataFrame:
    """``df`` with gap: the silence before and after each interval, together at most ``ceiling``."""
    order = Window.partitionBy(*row).orderBy(start, end)
    before = F.greatest(F.col(start) - F.lag(end).over(order), F.lit(0.0))
    after = F.greatest(F.lead(start).over(order) - F.col(end), F.lit(0.0))
    return df.withColumn("gap", F.least(F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0)), F.lit(ceiling)))


def role_order(df: DataFrame, row: list[str], position: str, role: str, roles: list[str]) -> DataFrame:
    """(pattern, n): the order in which the roles first occur in a row, for rows that have any."""
    firsts = df.filter(F.col(role).isin(roles)).groupBy(*row, role).agg(F.min(position).alias("at"))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", role))), lambda x: x[role]), "")
    return firsts.groupBy(*row).agg(pattern.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
