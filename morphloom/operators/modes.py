"""Alignment tables under different units: words as they are, guided by the reverse alignment, or classes of morphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.operators import align, induce

#: An aligner: (source, target) of (space, row, at, word) -> gloss table of the targets.
Aligner = Callable[[DataFrame, DataFrame], DataFrame]


def by_dice(source: DataFrame, target: DataFrame) -> DataFrame:
    """The gloss table of links by co-occurrence."""
    return align.gloss_table(align.dice_links(source, target, align.dice_scores(source, target, "space", "row", "word")))


def identity_table(source: DataFrame, target: DataFrame, aligner: Aligner = by_dice) -> DataFrame:
    """Words as they are."""
    return aligner(source, target)


def guided_table(source: DataFrame, target: DataFrame, aligner: Aligner = by_dice, least: float = 0.1, **split: int) -> DataFrame:
    """Source words split where the reverse alignment says that words of one stem share a target; then aligned."""
    reverse = align.best_glosses(aligner(target, source)).filter(F.col("prob") >= least)
    # of the reverse table the target is a source word, and its gloss a target word
    best = reverse.select("space", F.col("source").alias("target"), F.col("target").alias("source"))
    splits = induce.guided_splits(best, ["space"], **split)
    return aligner(induce.apply_splits(source, splits, ["space"]), target)


def factored_table(source: DataFrame, target: DataFrame, factors: DataFrame, aligner: Aligner = by_dice) -> DataFrame:
    """Target morphs replaced by their class where they have one; factors: (space, word, factor), a word once a space."""
    named = target.join(factors.select("space", "word", "factor"), ["space", "word"], "left")
    return aligner(source, named.select("space", "row", "at", F.coalesce("factor", "word").alias("word")))


def build_table(mode: str, source: DataFrame, target: DataFrame, factors: DataFrame | None = None, aligner: Aligner = by_dice) -> DataFrame:
    """The table of a mode: identity, guided or factored."""
    if mode == "identity":
        return identity_table(source, target, aligner)
    if mode == "guided":
        return guided_table(source, target, aligner)
    if mode == "factored" and factors is not None:
        return factored_table(source, target, factors, aligner)
    raise ValueError(f"unknown mode, or factors are missing: {mode}")
