"""Switches of a language: what its vocabulary and affixes say about its type, with a confidence, and cross-checked against another source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.functions.words import compatible, cross_checked

#: Distinct stems from which a process counts as productive.
STEMS = 8


def _switch(df: DataFrame, keys: list[str], name: str, value: Column, confidence: Column, support: Column) -> DataFrame:
    return df.select(*keys, F.lit(name).alias("switch"), value.cast("string").alias("value"), F.round(confidence, 2).alias("confidence"), support.cast("bigint").alias("support"))


def _spaces(vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    return vocabulary.select(*keys).distinct()


def polarity(affixes: DataFrame, keys: list[str], ratio: float = 1.3) -> DataFrame:
    """(keys, switch, value, confidence, support): prefixing, suffixing or both, by the numbers of affixes (keys, kind)."""
    side = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    n = affixes.groupBy(*keys).agg(side("prefix").alias("p"), side("suffix").alias("s"))
    p, s = F.col("p"), F.col("s")
    value = F.when(p > s * ratio, "prefixing").when(s > p * ratio, "suffixing").otherwise("both")
    return _switch(n, keys, "affix_polarity", value, 0.5 + F.least(F.lit(0.4), F.abs(p - s) / F.greatest(p + s, F.lit(1))), p + s)


def reduplication(vocabulary: DataFrame, keys: list[str], stems: int = STEMS) -> DataFrame:
    """Whether words that double an attested word, with a hyphen or at their beginning, recur. vocabulary: (keys, word, n).

    Words of four characters and two tokens at least. Each doubling that a word
    shows gives the words it may be made of; those are looked up by equality.
    """
    words = vocabulary.filter((F.length("word") >= 4) & (F.col("n") >= 2))
    before, after = F.substring_index("word", "-", 1), F.expr("substr(word, instr(word, '-') + 1)")
    cut = lambda at, size: F.substr("word", at, size)
    sizes = F.filter(F.sequence(F.lit(2), F.greatest(F.floor(F.length("word") / 2).cast("int"), F.lit(2))), lambda k: (cut(F.lit(1), k) == cut(k + 1, k)) & (F.length("word") >= 2 * k))
    bases = F.when(F.contains("word", F.lit("-")), F.when((before != "") & (before == after), F.array(before))).otherwise(F.flatten(F.transform(sizes, lambda k: F.array(cut(F.lit(1), k), F.substr("word", k + 1)))))
    asked = words.select(*keys, "word", F.explode(bases).alias("base"))
    real = asked.join(vocabulary.select(*keys, F.col("word").alias("base")).distinct(), [*keys, "base"], "left_semi")
    counted = _spaces(vocabulary, keys).join(real.groupBy(*keys).agg(F.countDistinct("word").alias("c")), keys, "left").fillna(0, ["c"])
    return _switch(counted, keys, "reduplication", F.col("c") >= stems, 0.5 + F.least(F.lit(0.4), F.col("c") / 30), F.col("c"))


def infixation(vocabulary: DataFrame, keys: list[str], stems: int = STEMS) -> DataFrame:
    """Whether two characters after a word's first recur as an insertion into attested words, and stand out among such insertions.

    The most frequent insertion needs ``stems`` distinct words and, among three
    insertions or more, three times the words of the median one.
    """
    base = vocabulary.filter(F.length("word").between(3, 9) & (F.col("n") >= 2)).select(*keys, F.col("word").alias("base")).distinct()
    cut = vocabulary.filter(F.length("word") >= 5).select(*keys, F.expr("substr(word, 2, 2)").alias("chunk"), F.expr("concat(left(word, 1), substr(word, 4))").alias("base"))
    counts = cut.join(base, [*keys, "base"], "left_semi").groupBy(*keys, "chunk").agg(F.countDistinct("base").alias("c"))
    per = counts.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("cs"))  # at most one a chunk
    joined = _spaces(vocabulary, keys).join(per, keys, "left").withColumn("cs", F.coalesce("cs", F.array().cast("array<bigint>")))
    top, size = F.coalesce(F.get("cs", F.lit(0)), F.lit(0)), F.size("cs")
    stands_out = (size < 3) | (top >= 3 * F.greatest(F.coalesce(F.get("cs", F.floor(size / 2).cast("int")), F.lit(0)), F.lit(1)))
    sure = F.when(size == 0, 0.55).otherwise(0.5 + F.least(F.lit(0.4), top / 40))
    return _switch(joined, keys, "infixation", (top >= stems) & stands_out, sure, top)


def gender_or_noun_class(vocabulary: DataFrame, affixes: DataFrame, keys: list[str], stems: int = STEMS) -> DataFrame:
    """noun-class where several short prefixes recur on the same stems, gender where endings -o and -a alternate, else none.

    vocabulary: (keys, word, n), affixes: (keys, form, kind). Words count from two
    tokens on. Prefixes of up to three characters leave an attested word of more
    than two; a stem with two of them counts, and a prefix with ``stems`` such stems.
    """
    attested = vocabulary.filter("n >= 2").select(*keys, "word").distinct()
    masculine = attested.filter((F.length("word") > 2) & F.col("word").endswith("o")).withColumn("rest", F.expr("concat(left(word, length(word) - 1), 'a')"))
    pairs = masculine.join(attested.select(*keys, F.col("word").alias("rest")), [*keys, "rest"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"))
    short = affixes.filter((F.col("kind") == "prefix") & F.length("form").between(1, 3)).select(*keys, F.col("form").alias("prefix")).distinct()
    cuts = attested.select(*keys, "word", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("__size")).filter(F.length("word") > F.col("__size") + 2)
    parts = cuts.select(*keys, F.expr("left(word, __size)").alias("prefix"), F.expr("substr(word, __size + 1)").alias("stem")).join(short, [*keys, "prefix"], "left_semi")
    parts = parts.join(attested.select(*keys, F.col("word").alias("stem")), [*keys, "stem"], "left_semi")
    multi = parts.groupBy(*keys, "stem").agg(F.collect_set("prefix").alias("ps")).filter(F.size("ps") >= 2)  # a set holds at most the short prefixes
    loads = multi.select(*keys, F.explode("ps").alias("prefix")).groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= stems)
    joined = _spaces(vocabulary, keys).join(pairs, keys, "left").join(multi.groupBy(*keys).agg(F.count(F.lit(1)).alias("multi")), keys, "left")
    joined = joined.join(loads.groupBy(*keys).agg(F.count(F.lit(1)).alias("strong")), keys, "left").fillna(0, ["pairs", "multi", "strong"])
    classes = (F.col("multi") >= 3 * stems) & (F.col("strong") >= 4) & (F.col("multi") >= F.col("pairs"))
    value = F.when(classes, "noun-class").when(F.col("pairs") >= stems, "gender").otherwise("none")
    return _switch(joined, keys, "gender_or_noun_class", value, F.when(classes, 0.7).when(F.col("pairs") >= stems, 0.65).otherwise(0.55), F.when(classes, F.col("multi")).otherwise(F.col("pairs")))


def synthesis_switch(found: DataFrame, keys: list[str]) -> DataFrame:
    """The type that ``induce.synthesis`` finds, surer the farther it is from where agglutinative begins; isolating by syllables at 0.85."""
    by_syllables = (F.col("type") == "isolating") & (F.col("index") >= 1.5)
    return _switch(found, keys, "synthesis", F.col("type"), F.when(by_syllables, 0.85).otherwise(F.least(F.lit(0.7), 0.5 + F.abs(F.col("index") - 2.3) / 4)), F.lit(None))


def alternations(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A switch that is on where a detector found alternations; found: (keys, n), a row for each key."""
    return _switch(found, keys, name, F.col("n") > 0, 0.5 + F.least(F.lit(0.4), F.col("n") / 10), F.col("n"))


def sweep(parts: list[DataFrame], reported: DataFrame | None, keys: list[str]) -> DataFrame:
    """All switches, and where another source reports one (keys, switch, reported), whether it agrees and the confidence after that."""
    found = reduce(DataFrame.unionByName, parts)
    if reported is None:
        return found.withColumns({"reported": F.lit(None).cast("string"), "agrees": F.lit(None).cast("boolean")})
    joined = found.join(reported.select(*keys, "switch", "reported"), [*keys, "switch"], "left")
    agrees = F.when(F.col("reported").isNotNull() & F.col("value").isNotNull(), compatible(F.col("value"), F.col("reported")))
    return joined.withColumn("agrees", agrees).withColumn("confidence", F.round(cross_checked(F.col("confidence"), F.col("agrees")), 2))


def alternating_segment(a: Column, b: Column, vowels: str = "aeiou") -> Column:
    """(changed, vocalic): the characters that only one of two forms has, in order, and whether a vowel is among them."""
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), 0)
    changed = F.array_sort(F.array_union(F.array_except(letters(a), letters(b)), F.array_except(letters(b), letters(a))))
    return F.struct(changed.alias("changed"), F.exists(changed, lambda x: F.instr(F.lit(vowels), x) > 0).alias("vocalic"))
