"""Word alignment from co-occurrence and by expectation maximisation, and gloss tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.operators.em import em_table  # noqa: F401 - part of this module's interface


def dice_scores(source: DataFrame, target: DataFrame, space: str, row: str, word: str) -> DataFrame:
    """(space, target, source, n_both, n_source, n_target, dice): how well words go together, by rows.

    source, target: (space, row, word). A word counts once a row, however often
    it stands there: dice = 2 n_both / (n_source + n_target).
    """
    s = source.select(F.col(space).alias("space"), F.col(row).alias("row"), F.col(word).alias("source")).filter(F.col("source").isNotNull()).distinct()
    t = target.select(F.col(space).alias("space"), F.col(row).alias("row"), F.col(word).alias("target")).filter(F.col("target").isNotNull()).distinct()
    n_s = s.groupBy("space", "source").agg(F.count(F.lit(1)).alias("n_source"))
    n_t = t.groupBy("space", "target").agg(F.count(F.lit(1)).alias("n_target"))
    both = s.join(t, ["space", "row"]).groupBy("space", "target", "source").agg(F.count(F.lit(1)).alias("n_both"))
    joined = both.join(n_s, ["space", "source"]).join(n_t, ["space", "target"])
    return joined.select("space", "target", "source", "n_both", "n_source", "n_target", (F.lit(2.0) * F.col("n_both") / (F.col("n_source") + F.col("n_target"))).alias("dice"))


def dice_links(source: DataFrame, target: DataFrame, scores: DataFrame) -> DataFrame:
    """(space, row, target_at, target, source, source_at): each target position's best source word of its row.

    source, target: (space, row, at, word). Of equal scores the lowest source
    position wins, then the smaller word. A word of a row is decided once, for all its positions.
    """
    first = source.groupBy("space", "row", F.col("word").alias("source")).agg(F.min("at").alias("source_at"))
    kinds = target.select("space", "row", F.col("word").alias("target")).distinct()
    options = kinds.join(first, ["space", "row"]).join(scores.select("space", "target", "source", "dice"), ["space", "target", "source"])
    order = Window.partitionBy("space", "row", "target").orderBy(F.desc("dice"), F.asc("source_at"), F.asc("source"))
    best = options.withColumn("__place", F.row_number().over(order)).filter("__place = 1").select("space", "row", "target", "source", "source_at")
    return target.select("space", "row", F.col("at").alias("target_at"), F.col("word").alias("target")).join(best, ["space", "row", "target"])


def gloss_table(links: DataFrame) -> DataFrame:
    """(space, target, source, n, prob, rank): link counts, their share of the target's links, ranked by count, then source."""
    counted = links.groupBy("space", "target", "source").agg(F.count(F.lit(1)).alias("n"))
    return rank_glosses(counted)


def rank_glosses(counted: DataFrame) -> DataFrame:
    """The gloss table of link counts (space, target, source, n)."""
    target = Window.partitionBy("space", "target")
    share = F.round(F.col("n") / F.sum("n").over(target), 4)
    return counted.withColumn("prob", share).withColumn("rank", F.row_number().over(target.orderBy(F.desc("n"), F.asc("source"))).cast("bigint"))


def best_glosses(table: DataFrame) -> DataFrame:
    """The first candidate of each target."""
    return table.filter(F.col("rank") == 1)


def sense_links(table: DataFrame, least_prob: float = 0.5, least_count: int = 2, ceiling: float = 0.6) -> DataFrame:
    """(op, space, reference_lemma, vernacular_sense, confidence): links from first candidates sure enough, to be confirmed."""
    sure = best_glosses(table).filter((F.col("prob") >= least_prob) & (F.col("n") >= least_count))
    return sure.select(
        F.lit("bilingual.sense_link.add").alias("op"), "space", F.col("source").alias("reference_lemma"), F.col("target").alias("vernacular_sense"), F.round(F.least("prob", F.lit(ceiling)), 4).alias("confidence")
    )


def confidence_tier(prob: Column, count: Column) -> Column:
    """high from half the links and two of them, medium from a quarter, else low."""
    return F.when((prob >= 0.5) & (count >= 2), "high").when(prob >= 0.25, "medium").otherwise("low")


def stem_group(word: Column, prefix: int = 5) -> Column:
    """The key under which words with a common beginning are grouped; shorter words stand alone."""
    return F.when(F.length(word) >= prefix, F.substring(word, 1, prefix)).otherwise(word)
