"""Detectors of typological traits and of unexplained mass, from vocabularies and affixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.functions.text import reduplicated, vowel_groups


def affix_polarity(affixes: DataFrame, keys: list[str], ratio: float = 1.3) -> DataFrame:
    """(keys, prefixes, suffixes, polarity): prefixing or suffixing where one side has more than ``ratio`` times the affixes of the other, else both."""
    side = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    counted = affixes.groupBy(*keys).agg(side("prefix").alias("prefixes"), side("suffix").alias("suffixes"))
    p, s = F.col("prefixes"), F.col("suffixes")
    return counted.withColumn("polarity", F.when(p > F.lit(ratio) * s, "prefixing").when(s > F.lit(ratio) * p, "suffixing").otherwise("both"))


def reduplication_rates(vocabulary: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, types, redup_types, type_rate, token_rate): words that begin by repeating themselves.

    The type rate is over words of at least ``least`` tokens, the token rate over all tokens.
    """
    hit = reduplicated(F.col("word")).isNotNull() & (F.col("n") >= least)
    return vocabulary.groupBy(*keys).agg(
        F.sum((F.col("n") >= least).cast("int")).alias("types"), F.sum(hit.cast("int")).alias("redup_types"),
        F.try_divide(F.sum(hit.cast("int")), F.sum((F.col("n") >= least).cast("int"))).alias("type_rate"),
        F.try_divide(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("token_rate"),
    )


def infixes(vocabulary: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """(keys, infix, stems): two characters that stand after the first of words that are words without them, for at least so many."""
    words = vocabulary.select(*keys, "word").distinct()
    cut = words.filter(F.length("word") >= 5).select(*keys, F.expr("substr(word, 2, 2)").alias("infix"), F.expr("concat(left(word, 1), substr(word, 4))").alias("stem"))
    known = words.select(*keys, F.col("word").alias("stem"))
    return cut.join(known, [*keys, "stem"], "left_semi").groupBy(*keys, "infix").agg(F.countDistinct("stem").alias("stems")).filter(F.col("stems") >= least)


def syllable_stats(vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, mean, monosyllables): vowel groups of the words of each key."""
    size = vowel_groups(F.col("word"))
    return vocabulary.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.avg(size).alias("mean"), F.avg((size == 1).cast("int")).alias("monosyllables"))


def tone_marks(vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, marked): the share of words with an accent, composed or combining."""
    hit = F.col("word").rlike("[\\u0300-\\u0304\\u0306-\\u036fàáâãāèéêẽēìíîĩīòóôõōùúûũū]")
    return vocabulary.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.avg(hit.cast("int")).alias("marked"))


def unexplained_mass(vocabulary: DataFrame, known: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, tokens, unknown, share): the token mass of recurring words that no lexicon holds. known: (keys, word)."""
    seen = known.select(*keys, "word").distinct().withColumn("__hit", F.lit(True))
    joined = vocabulary.join(seen, [*keys, "word"], "left")
    out = F.sum(F.when(F.col("__hit").isNull() & (F.col("n") >= least), F.col("n")).otherwise(0))
    return joined.groupBy(*keys).agg(F.sum("n").alias("tokens"), out.alias("unknown"), F.try_divide(out, F.sum("n")).alias("share"))


def homograph_share(lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, forms, homographs, share): forms with more than one part of speech."""
    per = lexicon.filter(F.col("form").isNotNull()).groupBy(*keys, "form").agg(F.countDistinct("pos").alias("n"))
    hit = F.sum((F.col("n") > 1).cast("int"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("forms"), hit.alias("homographs"), F.try_divide(hit, F.count(F.lit(1))).alias("share"))


def vowel_harmony(affixes: DataFrame, stems: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, suffix, front, back): after which stems a suffix stands, by the last vowel. stems: (keys, stem, suffix)."""
    last = F.regexp_extract("stem", "([aeiou])[^aeiou]*$", 1)
    joined = stems.join(affixes.select(*keys, F.col("form").alias("suffix")).distinct(), [*keys, "suffix"])
    front, back = last.isin("e", "i"), last.isin("a", "o", "u")
    return joined.groupBy(*keys, "suffix").agg(F.sum(front.cast("int")).alias("front"), F.sum(back.cast("int")).alias("back"))
