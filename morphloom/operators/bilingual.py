"""Bilingual dictionaries: lookup, translation checks, tag crosswalks, links from changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number tags.
NUMBER_TAGS = ("sg", "pl", "du")


def find_references(source: DataFrame, target: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_at, target_at, lemma, vernacular): target tokens that a source token's dictionary entries lead to.

    source: (keys, at, lemma), target: (keys, at, lemma) with a row for each
    analysis, dictionary: (reference, vernacular). A target token matches a source
    token once, whatever number of its analyses do.
    """
    entries = source.select(*keys, F.col("at").alias("source_at"), F.lower("lemma").alias("lemma")).join(dictionary.select(F.lower("reference").alias("lemma"), F.lower("vernacular").alias("vernacular")).distinct(), "lemma")
    hits = entries.join(target.select(*keys, F.col("at").alias("target_at"), F.lower("lemma").alias("vernacular")), [*keys, "vernacular"])
    return hits.groupBy(*keys, "source_at", "target_at", "lemma").agg(F.min("vernacular").alias("vernacular"))


def translation_flags(source: DataFrame, target: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_at, flag, confidence): source tokens whose translation is missing (0.6) or differs in number (0.7).

    source, target: (keys, at, lemma, tags). Only source lemmas the dictionary has
    can be missing; numbers differ if both sides name some and share none.
    """
    known = source.join(dictionary.select(F.lower("reference").alias("__r")).distinct(), F.lower("lemma") == F.col("__r"), "left_semi")
    found = find_references(source, target, dictionary, keys).select(*keys, "source_at", "target_at")
    missing = known.select(*keys, F.col("at").alias("source_at")).join(found, [*keys, "source_at"], "left_anti").distinct()
    number = lambda c: F.array_intersect(c, F.array(*[F.lit(t) for t in NUMBER_TAGS]))
    s = source.select(*keys, F.col("at").alias("source_at"), number("tags").alias("__s"))
    t = target.select(*keys, F.col("at").alias("target_at"), number("tags").alias("__t"))
    both = found.join(s, [*keys, "source_at"]).join(t, [*keys, "target_at"])
    wrong = both.filter((F.size("__s") > 0) & (F.size("__t") > 0) & ~F.arrays_overlap("__s", "__t")).select(*keys, "source_at").distinct()
    flag = lambda df, name, sure: df.select(*keys, "source_at", F.lit(name).alias("flag"), F.lit(sure).alias("confidence"))
    return flag(missing, "missing", 0.6).unionByName(flag(wrong, "number", 0.7))


def map_tags(tags: Column, crosswalk: Column) -> Column:
    """(mapped, unmapped): tags in the other inventory and those without counterpart, each in order."""
    return F.struct(
        F.transform(F.filter(tags, lambda t: F.map_contains_key(crosswalk, t)), lambda t: F.element_at(crosswalk, t)).alias("mapped"), F.filter(tags, lambda t: ~F.map_contains_key(crosswalk, t)).alias("unmapped")
    )


def invert(crosswalk: Column) -> Column:
    """A tag map turned round; of tags with one counterpart the greatest stays."""
    entries = F.array_sort(F.map_entries(crosswalk))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["value"] == e["value"]) & (o["key"] > e["key"])))
    return F.map_from_arrays(F.transform(last, lambda e: e["value"]), F.transform(last, lambda e: e["key"]))


def links_from_changes(changes: DataFrame) -> DataFrame:
    """(reference, reference_tags, vernacular, vernacular_tags): dictionary links of sense-link changes, each once, incomplete ones dropped.

    changes: (op, fields map); a sense or lemma may be text or a JSON object with ``entry`` or ``lemma``.
    """
    get = lambda k: F.nullif(F.try_element_at("fields", F.lit(k)), F.lit(""))
    named = lambda k, member: F.coalesce(F.get_json_object(F.when(get(k).startswith("{"), get(k)), f"$.{member}"), F.when(~get(k).startswith("{"), get(k)))
    rows = changes.filter(F.col("op") == "bilingual.sense_link.add").select(
        named("reference_lemma", "lemma").alias("reference"), F.coalesce(get("reference_tags"), F.lit("")).alias("reference_tags"), named("vernacular_sense", "entry").alias("vernacular"), F.coalesce(get("vernacular_tags"), F.lit("")).alias("vernacular_tags")
    )
    return rows.filter("reference is not null and vernacular is not null").distinct()


def dictionary_size(dictionary: DataFrame) -> DataFrame:
    """(entries, references, vernaculars, ambiguous): the size of a dictionary and its references with several counterparts."""
    per = dictionary.distinct().groupBy("reference").agg(F.countDistinct("vernacular").alias("n"))
    left = per.agg(F.count(F.lit(1)).alias("references"), F.sum("n").alias("entries"), F.sum((F.col("n") > 1).cast("int")).alias("ambiguous"))
    vernaculars = dictionary.agg(F.countDistinct("vernacular")).scalar()
    return left.select("entries", "references", vernaculars.alias("vernaculars"), "ambiguous")


def first_links(links: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first link of each key by the order column."""
    return links.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__k = 1").drop("__k")
