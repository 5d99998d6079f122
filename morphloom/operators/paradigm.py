"""Allomorphy, conditioning, paradigm reports and the order in which paradigms are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.operators.morph import near_forms


def complementary(profiles: DataFrame, pairs: DataFrame, keys: list[str], edge: str = "#") -> DataFrame:
    """(keys, left, right, dimension, score): how little the neighbourhoods of two forms overlap, in their most telling dimension.

    profiles: (keys, form, dimension, bucket, n), pairs: (keys, left, right). Word
    edges do not count; a dimension needs data on both sides; without any the
    pair has score 0 and an empty dimension.
    """
    inside = profiles.filter(F.col("bucket") != edge)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "form", "dimension"))
    shares = inside.select(*keys, "form", "dimension", "bucket", p.alias("p"))
    maps = shares.groupBy(*keys, "form", "dimension").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "p"))).alias("m"))
    left = maps.select(*keys, F.col("form").alias("left"), "dimension", F.col("m").alias("x"))
    right = maps.select(*keys, F.col("form").alias("right"), "dimension", F.col("m").alias("y"))
    both = pairs.join(left, [*keys, "left"]).join(right, [*keys, "right", "dimension"])
    overlap = F.aggregate(F.map_keys("x"), F.lit(0.0), lambda s, k: s + F.least(F.element_at("x", k), F.coalesce(F.try_element_at("y", k), F.lit(0.0))))
    scored = both.select(*keys, "left", "right", "dimension", (1 - overlap).alias("score"))
    order = Window.partitionBy(*keys, "left", "right").orderBy(F.desc("score"), F.desc("dimension"))
    best = scored.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
    return pairs.join(best, [*keys, "left", "right"], "left").select(*keys, "left", "right", F.coalesce("dimension", F.lit("")).alias("dimension"), F.coalesce("score", F.lit(0.0)).alias("score"))


def allomorphs(forms: DataFrame, profiles: DataFrame, features: DataFrame, keys: list[str], meaning_at: float = 0.5) -> DataFrame:
    """(keys, left, right, meaning, dimension, score): forms one edit apart with one meaning, by how they share out their environments.

    features: (keys, form, feature). meaning is the Jaccard overlap of the features.
    """
    pairs = near_forms(forms, keys)
    sets = features.groupBy(*keys, "form").agg(F.collect_set("feature").alias("f"))
    left, right = sets.select(*keys, F.col("form").alias("left"), F.col("f").alias("a")), sets.select(*keys, F.col("form").alias("right"), F.col("f").alias("b"))
    same = pairs.join(left, [*keys, "left"]).join(right, [*keys, "right"])
    meaning = F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 3)
    close = same.withColumn("meaning", meaning).filter(F.col("meaning") >= meaning_at).drop("a", "b")
    return complementary(profiles, close.select(*keys, "left", "right"), keys).join(close, [*keys, "left", "right"]).select(*keys, "left", "right", "meaning", "dimension", "score")


def is_artifact(host_share: Column, hosts: Column, most: float = 0.5, least: int = 4) -> Column:
    """Whether a split rests on too few hosts or on one of them; missing figures count as genuine."""
    return (F.coalesce(host_share, F.lit(0.0)) > most) | (F.coalesce(hosts, F.lit(99)) < least)


def best_environment(results: DataFrame, keys: list[str], least: float = 0.15) -> DataFrame:
    """The genuine environment with the highest gain, at least so much; ties go to fewer hosts, then the smaller label. results: (keys, label, gain, host_share, hosts)."""
    genuine = results.filter(~is_artifact(F.col("host_share"), F.col("hosts")) & (F.col("gain") >= least))
    order = Window.partitionBy(*keys).orderBy(F.desc("gain"), "hosts", "label")
    return genuine.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def norm_marker(text: Column) -> Column:
    """Markers as they are compared: lower case without hyphens, blanks, dots and brackets."""
    return F.regexp_replace(F.lower(text), r"[-\s.()]", "")


def report_score(cells: DataFrame, packet: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, completeness, faithfulness, overall): a report against the evidence it was written from.

    cells: (keys, marker, golden): markers of a report and of the golden one;
    packet: (keys, marker). completeness is the share of golden markers in evidence
    that the report names, faithfulness the share of its markers in evidence;
    overall is their product.
    """
    evidence = packet.select(*keys, norm_marker(F.col("marker")).alias("m")).distinct().withColumn("seen", F.lit(1))
    marks = cells.select(*keys, "golden", norm_marker(F.col("marker")).alias("m")).distinct().join(evidence, [*keys, "m"], "left")
    own = marks.filter(~F.col("golden")).select(*keys, "m", F.lit(1).alias("named"))
    gold = marks.filter("golden and seen is not null").join(own, [*keys, "m"], "left").groupBy(*keys).agg(F.avg(F.coalesce("named", F.lit(0))).alias("completeness"))
    faith = marks.filter(~F.col("golden")).groupBy(*keys).agg(F.avg(F.coalesce("seen", F.lit(0))).alias("faithfulness"))
    both = gold.join(faith, keys, "full_outer").fillna(0.0, ["completeness", "faithfulness"])
    return both.withColumn("overall", F.col("completeness") * F.col("faithfulness"))


def frontier(probes: DataFrame, keys: list[str], proxy_weight: float = 0.6) -> DataFrame:
    """(keys, probe, unexplained, proxy, weight, place, next): ready probes by unexplained mass, proxies for less; next marks the first that is none.

    probes: (keys, probe, unexplained, proxy, ready).
    """
    weight = F.least(F.col("unexplained"), F.lit(1.0)) * F.when(F.col("proxy"), proxy_weight).otherwise(1.0)
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "probe")
    ranked = probes.filter("ready").withColumn("weight", weight).withColumn("place", F.row_number().over(order).cast("bigint"))
    first = F.min(F.when(~F.col("proxy"), F.col("place"))).over(Window.partitionBy(*keys))
    return ranked.withColumn("next", F.coalesce(F.col("place") == first, F.lit(False))).select(*keys, "probe", "unexplained", "proxy", "weight", "place", "next")


def rotate_options(options: Column, by: int) -> Column:
    """An array turned to the left by so many places."""
    n = F.size(options)
    k = F.pmod(F.lit(by), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(options, k + 1, n), F.slice(options, F.lit(1), k))


def discriminating(parses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word): words that hypotheses read differently. parses: (keys, hypothesis, word, line)."""
    per = parses.groupBy(*keys, "hypothesis", "word").agg(F.array_join(F.array_sort(F.collect_set("line")), "|").alias("lines"))
    return per.groupBy(*keys, "word").agg(F.countDistinct("lines").alias("n")).filter("n > 1").select(*keys, "word")


def rank_hypotheses(assessed: DataFrame, keys: list[str]) -> DataFrame:
    """``assessed`` (keys, id, acceptable, delta_bits, overgeneration, net) with place: acceptable ones first, then fewer bits, less overgeneration, more net gain, id."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("acceptable"), F.asc_nulls_last("delta_bits"), F.asc_nulls_last("overgeneration"), F.desc_nulls_last("net"), "id")
    return assessed.withColumn("place", F.row_number().over(order).cast("bigint"))
