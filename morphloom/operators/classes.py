"""Noun classes and agreement: votes of neighbours, prefix pairs, priorities, exceptions."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def class_votes(sequence: DataFrame, keys: list[str], row: list[str], position: str, word: str, nouns: DataFrame, markers: DataFrame) -> DataFrame:
    """(keys, noun, marker, n): how often a noun is followed at once by a marker.

    nouns: (keys, noun), markers: (keys, marker).
    """
    after = F.lead(word).over(Window.partitionBy(*keys, *row).orderBy(position))
    pairs = sequence.select(*keys, F.col(word).alias("noun"), after.alias("marker")).filter(F.col("marker").isNotNull())
    kept = pairs.join(nouns.select(*keys, "noun").distinct(), [*keys, "noun"], "left_semi").join(markers.select(*keys, "marker").distinct(), [*keys, "marker"], "left_semi")
    return kept.groupBy(*keys, "noun", "marker").agg(F.count(F.lit(1)).alias("n"))


def concord(votes: DataFrame, keys: list[str], support: int = 20, share: float = 0.5, zero: str = "Ø") -> DataFrame:
    """(keys, noun_class, marker, n, share): the marker a class agrees in; ``zero`` counts in the share but never wins.

    votes: (keys, noun_class, marker, n).
    """
    by = Window.partitionBy(*keys, "noun_class")
    ranked = votes.withColumn("share", F.col("n") / F.sum("n").over(by)).filter(F.col("marker") != zero)
    best = ranked.withColumn("__k", F.row_number().over(by.orderBy(F.desc("n"), "marker"))).filter("__k = 1").drop("__k")
    return best.filter((F.col("n") >= support) & (F.col("share") >= share)).select(*keys, "noun_class", "marker", "n", "share")


def gender_classes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, noun, gender, confidence, exception): M or F by the articles seen, against what the ending suggests.

    votes: (keys, noun, m, f). Ties are M. Confidence is the winner's share times
    min(1, votes / 5). An exception disagrees with its ending.
    """
    total = F.col("m") + F.col("f")
    gender = F.when(F.col("m") >= F.col("f"), "M").otherwise("F")
    sure = F.greatest("m", "f") / total * F.least(F.lit(1.0), total / 5)
    expected = ending_gender(F.col("noun"))
    return votes.filter(total > 0).select(*keys, "noun", gender.alias("gender"), sure.alias("confidence"), F.coalesce(expected != gender, F.lit(False)).alias("exception"))


def ending_gender(noun: Column) -> Column:
    """The gender a Romance ending suggests: o is M; a, ión, dad, tad, umbre are F; else null."""
    return F.when(noun.rlike("(a|ión|dad|tad|umbre)$"), "F").when(noun.endswith("o"), "M")


def class_prefixes(vocabulary: DataFrame, keys: list[str], longest: int = 3, stems: int = 6, partners: int = 3, good: int = 4) -> DataFrame:
    """(keys, prefix, stems): beginnings that alternate: on at least ``good`` stems that take ``partners`` other beginnings, none inside another."""
    cut = vocabulary.select(*keys, "word").distinct().filter(F.length("word") > 3).withColumn("__cut", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    split = cut.filter(F.length("word") - F.col("__cut") >= 3).select(*keys, F.expr("left(word, __cut)").alias("prefix"), F.expr("substr(word, __cut + 1)").alias("stem")).distinct()
    common = split.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= stems)
    kept = split.join(common.select(*keys, "prefix"), [*keys, "prefix"], "left_semi")
    sets = kept.groupBy(*keys, "stem").agg(F.array_sort(F.collect_set("prefix")).alias("all"))
    other = F.size(F.filter("all", lambda p: (p != F.col("prefix")) & ~F.startswith(p, F.col("prefix")) & ~F.startswith(F.col("prefix"), p)))
    each = sets.withColumn("prefix", F.explode("all")).withColumn("others", other).filter(F.col("others") >= partners)
    return each.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("stems")).filter(F.col("stems") >= good)


def class_pairs(vocabulary: DataFrame, prefixes: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, singular, plural, shared): pairs of beginnings by the stems they share, greedily: a beginning is used once.

    Pairs are taken by falling number of shared stems, then by name. The table of
    pairs is small (beginnings of up to three characters), and each key's is walked
    by itself: the choice depends on the choices before it.
    """
    cut = vocabulary.select(*keys, "word").distinct().withColumn("__cut", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter(F.length("word") - F.col("__cut") >= 3)
    split = cut.select(*keys, F.expr("left(word, __cut)").alias("prefix"), F.expr("substr(word, __cut + 1)").alias("stem")).distinct()
    split = split.join(prefixes.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
    sets = split.groupBy(*keys, "stem").agg(F.array_sort(F.collect_set("prefix")).alias("all"))
    pairs = F.flatten(F.transform("all", lambda p: F.transform(F.filter("all", lambda q: (q > p) & ~F.startswith(q, p)), lambda q: F.struct(p.alias("singular"), q.alias("plural")))))
    shared = sets.withColumn("p", F.explode(pairs)).groupBy(*keys, "p.singular", "p.plural").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)

    def greedy(frame):
        frame = frame.sort_values(["shared", "singular", "plural"], ascending=[False, True, True])
        used, keep = set(), []
        for a, b in zip(frame["singular"], frame["plural"], strict=True):
            keep.append(a not in used and b not in used)
            if keep[-1]:
                used |= {a, b}
        return frame[keep]

    return shared.groupBy(*keys).applyInPandas(greedy, shared.schema)


def by_priority(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """(keys, value): of several relations, the value of the last one that has the key."""
    rows = None
    for rank, df in enumerate(sources):
        one = df.select(*keys, value).withColumn("__rank", F.lit(rank))
        rows = one if rows is None else rows.unionByName(one)
    order = Window.partitionBy(*keys).orderBy(F.desc("__rank"), value)
    return rows.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*keys, value)


def carve(nouns: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, environment, noun): exceptions carved into the environments that explain most of what is left, the largest first.

    Environments are the first letter if it is an a, and the last three and two
    letters. Each key's largest environment (ties: the smallest name) takes its
    nouns, again and again until none has ``least`` left. Nouns with the same
    environments go together, so each key's sets of environments with their counts
    are walked by themselves: as many as there are endings, however many the nouns.
    """
    envs = F.array_compact(F.array(F.when(F.col("noun").startswith("a"), "a-"), F.when(F.length("noun") >= 3, F.concat(F.lit("-"), F.expr("right(noun, 3)"))), F.when(F.length("noun") >= 2, F.concat(F.lit("-"), F.expr("right(noun, 2)")))))
    listed = nouns.select(*keys, "noun").distinct().withColumn("__envs", envs).filter(F.size("__envs") > 0)
    sets = listed.groupBy(*keys, "__envs").agg(F.count(F.lit(1)).alias("n"))

    def greedy(frame):
        of, left, taken = {}, Counter(), {}
        for i, (names, n) in enumerate(zip(frame["__envs"], frame["n"], strict=True)):
            for name in names:
                of.setdefault(name, []).append(i)
                left[name] += int(n)
        heap = [(-n, name) for name, n in left.items()]
        heapq.heapify(heap)
        while heap:
            n, name = heapq.heappop(heap)
            if left[name] < least:
                continue
            if -n != left[name]:
                heapq.heappush(heap, (-left[name], name))
                continue
            for i in of[name]:
                if i not in taken:
                    taken[i] = name
                    for other in frame["__envs"].iat[i]:
                        left[other] -= int(frame["n"].iat[i])
        return pd.DataFrame({c: [frame[c].iat[i] for i in taken] for c in (*keys, "__envs")} | {"environment": list(taken.values())}, dtype=object)

    kept = StructType([*sets.select(*keys, "__envs").schema, StructField("environment", StringType())])
    won = sets.groupBy(*keys).applyInPandas(greedy, kept)
    return listed.join(won, [*keys, "__envs"]).select(*keys, "environment", "noun")
