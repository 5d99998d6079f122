"""Assessing grammars: coverage, ambiguity, recall, boundaries, description length, ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(words: DataFrame, parses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, types, parsed, type_coverage, token_coverage): the share of words with a reading, by type and by token.

    words: (keys, word, n); parses: (keys, word, analysis).
    """
    known = parses.select(*keys, "word").distinct().withColumn("hit", F.lit(1))
    joined = words.join(known, [*keys, "word"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("types"),
        F.sum("hit").alias("parsed"),
        F.avg("hit").alias("type_coverage"),
        F.try_divide(F.sum(F.col("hit") * F.col("n")), F.sum("n")).alias("token_coverage"),
    )


def ambiguity(parses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, rate, geometric_mean): readings of parsed words, and the share of those with several."""
    per = parses.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.avg("n").alias("mean"), F.avg((F.col("n") > 1).cast("int")).alias("rate"), F.exp(F.avg(F.log("n"))).alias("geometric_mean"))


def roundtrip(parses: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gold, found, recall): the share of gold lines among the readings of their word. gold: (keys, word, line)."""
    hit = parses.select(*keys, "word", "line").distinct().withColumn("hit", F.lit(1))
    joined = gold.join(hit, [*keys, "word", "line"], "left")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def overgeneration(parses: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, readings, spurious, rate): readings of gold words that are not gold."""
    right = gold.select(*keys, "word", "line").distinct().withColumn("hit", F.lit(1))
    of_gold = parses.join(gold.select(*keys, "word").distinct(), [*keys, "word"], "left_semi").join(right, [*keys, "word", "line"], "left")
    spurious = F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0))
    return of_gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("readings"), spurious.alias("spurious"), F.try_divide(spurious, F.count(F.lit(1))).alias("rate"))


def non_regression(before: DataFrame, after: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lost, spurious): gold lines read before but not after, and other lines of gold words read only after."""
    key = [*keys, "word", "line"]
    b, a, g = (x.select(*key).distinct() for x in (before, after, gold))
    lost = g.join(b, key, "left_semi").join(a, key, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("lost"))
    new = a.join(g.select(*keys, "word").distinct(), [*keys, "word"], "left_semi").join(g, key, "left_anti").join(b, key, "left_anti")
    spurious = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("spurious"))
    both = g.select(*keys).distinct().join(lost, keys, "left").join(spurious, keys, "left")
    return both.select(*keys, F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("spurious", F.lit(0)).alias("spurious"))


def boundaries(forms: Column) -> Column:
    """The inner boundaries of morphs joined by ``-``: offsets into the word."""
    lengths = F.transform(F.split(forms, "-"), lambda m: F.length(m))
    return F.transform(F.sequence(F.lit(1), F.size(lengths) - 1, F.lit(1)), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x))


def boundary_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], forms: str = "forms") -> DataFrame:
    """(keys, hits, precision, recall, f1): morph boundaries of all words of either side together."""
    cut = lambda df, name: df.select(*keys, "word", F.when(F.col(forms).contains("-"), boundaries(F.col(forms))).otherwise(F.array().cast("array<int>")).alias(name))
    joined = cut(predicted, "p").join(cut(gold, "g"), [*keys, "word"], "full_outer")
    p, g = (F.coalesce(F.col(c), F.array().cast("array<int>")) for c in "pg")
    sums = joined.groupBy(*keys).agg(F.sum(F.size(F.array_intersect(p, g))).alias("hits"), F.sum(F.size(p)).alias("n_p"), F.sum(F.size(g)).alias("n_g"))
    precision, recall = F.try_divide("hits", "n_p"), F.try_divide("hits", "n_g")
    f1 = F.try_divide(F.lit(2.0) * F.col("hits"), F.col("n_p") + F.col("n_g"))
    return sums.select(*keys, "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def dead_constructs(inventory: DataFrame, used: DataFrame, keys: list[str], gloss: str = "gloss") -> DataFrame:
    """(keys, gloss): constructs of the inventory that no reading uses."""
    return inventory.select(*keys, gloss).distinct().join(used.select(*keys, gloss).distinct(), [*keys, gloss], "left_anti")


def tolerance(items: Column, exceptions: Column) -> Column:
    """Whether a rule over so many items tolerates so many exceptions: at most N / ln N; null below two items."""
    return F.when(items >= 2, exceptions <= items / F.log(items.cast("double")))


def grammar_length(roots: DataFrame, affixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits): the description length of a grammar.

    A form costs log2 of (alphabet + 1) for each character and one more for its
    end, a root log2 of the parts of speech, an affix one bit for its side and log2
    of the slots. The alphabet counts at least two characters, parts and slots at
    least one. roots: (keys, form, pos), affixes: (keys, form, slot).
    """
    letters = roots.select(*keys, "form").unionByName(affixes.select(*keys, "form")).filter(F.col("form").isNotNull())
    alphabet = letters.select(*keys, F.explode(F.regexp_extract_all("form", F.lit("(?s)."), 0)).alias("c")).groupBy(*keys).agg(F.greatest(F.countDistinct("c"), F.lit(2)).alias("sigma"))
    parts = roots.groupBy(*keys).agg(F.greatest(F.countDistinct("pos"), F.lit(1)).alias("parts"))
    slots = affixes.groupBy(*keys).agg(F.greatest(F.countDistinct("slot"), F.lit(1)).alias("slots"))
    r = roots.filter(F.col("form").isNotNull()).groupBy(*keys).agg(F.sum(F.length("form") + 1).alias("r_chars"), F.count(F.lit(1)).alias("r_n"))
    a = affixes.filter(F.col("form").isNotNull()).groupBy(*keys).agg(F.sum(F.length("form") + 1).alias("a_chars"), F.count(F.lit(1)).alias("a_n"))
    joined = alphabet.join(parts, keys, "left").join(slots, keys, "left").join(r, keys, "left").join(a, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bits = (zero("r_chars") + zero("a_chars")) * F.log2(F.col("sigma") + 1) + zero("r_n") * F.log2(F.coalesce("parts", F.lit(1))) + zero("a_n") * (1 + F.log2(F.coalesce("slots", F.lit(1))))
    return joined.select(*keys, bits.alias("bits"))


def data_length(words: DataFrame, parses: DataFrame, alphabet: DataFrame, keys: list[str], gold: DataFrame | None = None) -> DataFrame:
    """(keys, bits): the description length of a corpus under its readings.

    Of each word the gold line is taken if it is among the readings, else the first
    reading, in the order of the lines. A morph, named by its gloss, costs minus
    log2 of its token share, a word log2 of its readings on top; a word without
    reading costs log2 of the alphabet for each character. words: (keys, word, n);
    parses, gold: (keys, word, line), of several gold lines the first counts;
    alphabet: (keys, sigma).
    """
    lines = parses.select(*keys, "word", "line").distinct()
    first = F.min("line")
    if gold is not None:
        right = gold.groupBy(*keys, "word").agg(F.min("line").alias("line")).withColumn("__gold", F.lit(True))
        lines = lines.join(right, [*keys, "word", "line"], "left")
        first = F.coalesce(F.min(F.when(F.col("__gold"), F.col("line"))), F.min("line"))
    per = lines.groupBy(*keys, "word").agg(first.alias("line"), F.count(F.lit(1)).alias("readings"))
    joined = words.join(per, [*keys, "word"], "left")
    morphs = joined.filter(F.col("line").isNotNull()).select(*keys, "word", "n", F.explode(F.split("line", "-")).alias("morph"))
    counted = morphs.groupBy(*keys, "morph").agg(F.sum("n").alias("c"))
    cost = counted.withColumn("bits", -F.log2(F.col("c") / F.sum("c").over(Window.partitionBy(*keys))))
    read = morphs.join(cost.select(*keys, "morph", "bits"), [*keys, "morph"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("bits")).alias("m"))
    rest = joined.join(alphabet, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("line").isNotNull(), F.col("n") * F.log2("readings")).otherwise(F.col("n") * F.length("word") * F.log2("sigma"))).alias("rest")
    )
    return rest.join(read, keys, "left").select(*keys, (F.col("rest") + F.coalesce("m", F.lit(0.0))).alias("bits"))


def worst_parts(parses: DataFrame, gold: DataFrame, keys: list[str], weight: float = 1.0) -> DataFrame:
    """(keys, gloss, words, lost, spared, worst): what leaving each construct out would cost and spare.

    A construct is a gloss of the readings. Without it the readings that use it
    go: gold lines among them are lost, others spared. worst = weight x spared -
    lost, both by gold words; the higher, the more the grammar gains without it.
    """
    lines = parses.select(*keys, "word", "line").distinct()
    right = gold.select(*keys, "word", "line").distinct().withColumn("hit", F.lit(1))
    judged = lines.join(gold.select(*keys, "word").distinct(), [*keys, "word"], "left_semi").join(right, [*keys, "word", "line"], "left")
    used = judged.withColumn("gloss", F.explode(F.array_distinct(F.split("line", "-"))))
    out = used.groupBy(*keys, "gloss").agg(F.countDistinct("word").alias("words"), F.count("hit").alias("lost"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("spared"))
    return out.withColumn("worst", F.lit(weight) * F.col("spared") - F.col("lost"))


def ablation(items: DataFrame, keys: list[str], count: str, order: list[str], rank: int) -> DataFrame:
    """The item at place ``rank`` (from 0, modulo the number of items) by falling count, then ``order``, of each key."""
    by = Window.partitionBy(*keys)
    placed = items.withColumn("__k", F.row_number().over(by.orderBy(F.desc(count), *order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    return placed.filter(F.col("__k") == F.lit(rank) % F.col("__n")).drop("__k", "__n")
