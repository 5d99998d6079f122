"""Evidence from timestamped words and recognised phones. Recognition itself is outside; its output is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.operators.sequence import boundary_gaps, context


def normalised(word: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(word)), r"[^\p{L}\p{N}]", "")


def match_kind(sample: Column, word: Column, stems: Column) -> Column:
    """exact, stem (a stem begins the word) or null."""
    return F.when(sample == word, "exact").when(F.exists(stems, lambda s: (F.length(s) > 0) & F.startswith(word, s)), "stem")


def anchor_covers(anchor: Column, ref: Column) -> Column:
    """Whether a recording's anchor covers a reference: the same, or the reference goes on after it."""
    return (ref == anchor) | F.startswith(ref, F.concat(anchor, F.lit(":"))) | F.startswith(ref, F.concat(anchor, F.lit(" ")))


def occurrences(samples: DataFrame, words: DataFrame) -> DataFrame:
    """(sample, source_id, word, start, end, match, score, left, right, place): where samples are heard, best first.

    samples: (sample, stems), words: (source_id, word, start, end, probability).
    score is the recogniser's probability, with 0.2 off for stem matches and the
    silence around the word on top. Exact matches join by equality; stem matches by
    the stem's first characters, which are then compared in full.
    """
    heard = context(boundary_gaps(words, ["source_id"], "start", "end"), ["source_id"], "start", "word").withColumn("w", normalised(F.col("word")))
    s = samples.select("sample", normalised(F.col("sample")).alias("key"), F.transform("stems", lambda x: normalised(x)).alias("stems"))
    exact = s.select("sample", "stems", F.col("key").alias("w")).join(heard, "w").withColumn("match", F.lit("exact"))
    stems = s.select("sample", "key", "stems", F.explode("stems").alias("stem")).filter("length(stem) > 0")
    near = stems.join(heard, (F.substring("stem", 1, 2) == F.substring("w", 1, 2)) & F.startswith("w", F.col("stem")) & (F.col("w") != F.col("key")))
    near = near.drop("key", "stem").dropDuplicates(["sample", "source_id", "start"]).withColumn("match", F.lit("stem"))
    score = F.col("probability") - F.when(F.col("match") == "stem", 0.2).otherwise(0.0) + F.col("gap")
    rows = exact.unionByName(near.select(exact.columns)).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("score"), "start", "source_id"))
    return rows.withColumn("place", place.cast("bigint")).select("sample", "source_id", "word", "start", "end", "match", "score", "left", "right", "place")


def spelling_alerts(evidence: DataFrame) -> DataFrame:
    """(phones, words, spellings): words spelled differently that sound alike, two at least. evidence: (word, phones array)."""
    grouped = evidence.filter(F.size("phones") > 0).groupBy(F.array_join("phones", " ").alias("phones")).agg(F.array_sort(F.collect_set("word")).alias("s"))
    return grouped.filter(F.size("s") >= 2).select("phones", F.size("s").cast("bigint").alias("words"), F.array_join("s", " ").alias("spellings"))


def feature_mismatches(expected: Column, observed: Column) -> Column:
    """Positions at which two phone sequences differ, plus the difference of their lengths."""
    shorter = F.least(F.size(expected), F.size(observed))
    pairs = F.zip_with(F.slice(expected, F.lit(1), shorter), F.slice(observed, F.lit(1), shorter), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) + F.abs(F.size(expected) - F.size(observed))


def conditioning(evidence: DataFrame, least: int = 2) -> DataFrame:
    """(member, n, with_feature, verdict): whether the phones beside a member bear the feature said to condition it.

    evidence: (member, has_feature). confirmed where all do, conflict where none
    does, mixed between, insufficient below ``least``.
    """
    counted = evidence.filter("has_feature is not null").groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_feature").cast("int")).alias("with_feature"))
    verdict = F.when(F.col("n") < least, "insufficient").when(F.col("with_feature") == F.col("n"), "confirmed").when(F.col("with_feature") == 0, "conflict").otherwise("mixed")
    return counted.withColumn("verdict", verdict)
