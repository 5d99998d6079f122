"""Top N items within every group (problem 3): two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups a group is hashed into. A group with a third of all rows is ranked by this many tasks.
SUBGROUPS = 32


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, item: str, subgroups: int | str = SUBGROUPS, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group under ``order``, numbered from 1 in ``place``.

    Stage one hashes each group into ``subgroups`` by the item's identifier (or
    takes the column of that name as the subgroup: rows that are partitioned by
    it already are ranked where they are) and keeps n rows in each; stage two ranks the survivors, at most n x subgroups a
    group, by the same order. Since a row among the first n of its group is among
    the first n of its subgroup, nothing is lost. Both ranks are limited before
    their exchange too, so a task sends at most n rows of a (sub)group.

    order must end in a column that is unique in the group, so ties have one
    order; equal rows would be numbered in any order. Null group values form a
    group. Fewer than n rows: all of them. An empty table gives an empty table.
    """
    salt, rank = "__salt", "__rank"
    while salt in df.columns or rank in df.columns:
        salt, rank = salt + "_", rank + "_"
    hashed = F.col(subgroups) if isinstance(subgroups, str) else F.pmod(F.xxhash64(F.col(item)), F.lit(subgroups)).cast("int")
    salted = df.withColumn(salt, hashed)
    inner = Window.partitionBy(*group, salt).orderBy(*order)
    survivors = salted.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= n).drop(rank, salt)
    outer = Window.partitionBy(*group).orderBy(*order)
    return survivors.withColumn(place, F.row_number().over(outer).cast("bigint")).filter(F.col(place) <= n)
