"""Projecting annotations of a pivot language through a gloss table onto words, and what follows from them.

Pivot annotations come from outside: (row, i, text, pos, dep, head, feats) with
head the position of the governing token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.operators.stats import modal


def project(pivot: DataFrame, target: DataFrame, best: DataFrame) -> DataFrame:
    """(row, at, word, role, pos, feats, head_word): target words with the annotation of the pivot word they align with.

    target: (row, at, word), best: (word, source). A pivot text counts once a row,
    at its first position; proper names are dropped. head_word is the first target
    word of the row that aligns with the governing token's text.
    """
    first = Window.partitionBy("row", "text").orderBy("i")
    tokens = pivot.withColumn("text", F.lower("text")).withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    named = tokens.filter("pos <> 'PROPN'").select("row", F.col("text").alias("source"), "pos", F.col("dep").alias("role"), "feats", "head")
    aligned = target.join(best.select("word", "source"), "word").join(named, ["row", "source"])
    heads = pivot.select("row", F.col("i").alias("head"), F.lower("text").alias("head_text"))
    back = target.join(best.select("word", "source"), "word").groupBy("row", F.col("source").alias("head_text")).agg(F.min_by("word", "at").alias("head_word"))
    return aligned.join(heads, ["row", "head"], "left").join(back, ["row", "head_text"], "left").select("row", "at", "word", "role", "pos", "feats", "head_word")


def derive_pos(projected: DataFrame, least: int = 2) -> DataFrame:
    """(word, pos, n, total): the part of speech projected onto a word most often, with at least so many projections."""
    return modal(projected, ["word"], "pos").filter(F.col("total") >= least).select("word", "pos", "n", "total")


def word_order(projected: DataFrame) -> DataFrame:
    """(pattern, n): orders of subject, verb and object, by their first words in a row."""
    role = F.when(F.col("role").isin("nsubj", "nsubjpass"), "S").when(F.col("role").isin("obj", "dobj"), "O").when(F.col("pos") == "VERB", "V")
    firsts = projected.withColumn("r", role).filter("r is not null").groupBy("row", "r").agg(F.min("at").alias("at"))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]), "")
    return firsts.groupBy("row").agg(pattern.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def subject_verbs(projected: DataFrame) -> DataFrame:
    """(row, noun, verb): projected subjects with the word of their verb."""
    return projected.filter(F.col("role").isin("nsubj", "nsubjpass") & F.col("head_word").isNotNull()).select("row", F.col("word").alias("noun"), F.col("head_word").alias("verb"))


def first_marker(word: Column, markers: list[str], rest: int = 2) -> Column:
    """The first of the ordered markers that a word begins with, with at least ``rest`` characters after it; else ``?``."""
    out = F.lit("?")
    for marker in reversed(markers):
        out = F.when(word.startswith(marker) & (F.length(word) >= len(marker) + rest), marker).otherwise(out)
    return out


def tense_slots(projected: DataFrame, markers: list[str], least: int = 8) -> DataFrame:
    """(slot, tense, n, share): the two characters after the subject marker and the tense that goes with them most often."""
    marker = first_marker(F.col("word"), markers)
    verbs = projected.filter("pos = 'VERB'").withColumn("m", marker).filter("m <> '?'")
    slots = verbs.select(F.expr("substr(word, length(m) + 1, 2)").alias("slot"), F.try_element_at("feats", F.lit("Tense")).alias("tense")).filter("tense is not null and length(slot) = 2")
    return modal(slots, ["slot"], "tense").filter(F.col("total") >= least).select("slot", "tense", "n", "share")


def negation(projected: DataFrame, pivot: DataFrame, least: int = 10, ratio: float = 2.0) -> DataFrame:
    """(prefix, negated, affirmed, ratio): first two characters of verbs much more frequent in rows whose pivot text is negated."""
    neg = pivot.groupBy("row").agg(F.max((F.lower("text").isin("not", "n't", "never", "no") | (F.col("dep") == "neg")).cast("int")).alias("neg"))
    verbs = projected.filter("pos = 'VERB' and length(word) > 3").join(neg, "row").groupBy(F.expr("left(word, 2)").alias("prefix"))
    counted = verbs.agg(F.sum("neg").alias("negated"), F.sum(1 - F.col("neg")).alias("affirmed")).withColumn("ratio", F.col("negated") / (F.col("affirmed") + 1))
    return counted.filter((F.col("negated") >= least) & (F.col("ratio") >= ratio))


def role_suffixes(projected: DataFrame, vowels: str = "aeiou", stems: int = 4, purity: float = 0.4) -> DataFrame:
    """(family, role, n, share, stems): endings, without their vowels, that go with one grammatical role.

    Endings of one to three characters on nominal words with at least two before.
    """
    nouns = projected.filter("pos in ('NOUN', 'PRON') and role is not null").withColumn("__cut", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter("length(word) - __cut >= 2")
    ends = nouns.select(F.expr("right(word, __cut)").alias("ending"), F.expr("left(word, length(word) - __cut)").alias("stem"), "role")
    families = ends.withColumn("family", F.coalesce(F.nullif(F.translate("ending", vowels, ""), F.lit("")), F.col("ending")))
    size = families.groupBy("family").agg(F.countDistinct("stem").alias("stems"))
    best = modal(families, ["family"], "role", share=purity)
    return best.join(size, "family").filter(F.col("stems") >= stems).select("family", "role", "n", "share", "stems")


def determiner_votes(projected: DataFrame, least: int = 8, top: int = 4) -> DataFrame:
    """(ending, before, n, place): the words before nouns by the nouns' last letter."""
    before = F.lag("word", 1, "<s>").over(Window.partitionBy("row").orderBy("at"))
    seen = projected.withColumn("before", before).filter("pos = 'NOUN'").groupBy(F.expr("right(word, 1)").alias("ending"), "before").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("ending").orderBy(F.desc("n"), "before"))
    return seen.withColumn("place", place).filter(F.col("place") <= top)


def agreement_endings(pairs: DataFrame, least: int = 20, top: int = 6) -> DataFrame:
    """(number, ending, n): last two characters of verbs by the number of their subject. pairs: (verb, number)."""
    counted = pairs.groupBy("number", F.expr("right(verb, 2)").alias("ending")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("n"), "ending"))
    return counted.withColumn("__k", place).filter(F.col("__k") <= top).drop("__k")
