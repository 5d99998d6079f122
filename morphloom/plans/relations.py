"""The relations that the queries share, made of a data folder's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.operators.live import live_rows
from morphloom.plans.tables import table


def markers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Live morph markers with the columns asked for."""
    return live_rows(table(spark, folder, "morph_markers").select("marker_id", "loaded_at", *columns), "marker_id", "loaded_at")


def verse_words(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, verse, at, word): the words of the verses, in lower case."""
    rows = markers(spark, folder, "pair", "verse", "word_idx", "word").filter(F.col("word").isNotNull())
    return rows.groupBy("pair", "verse", F.col("word_idx").alias("at")).agg(F.lower(F.min("word")).alias("word"))


def source_words(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, verse, at, word): source words that stand beside the words of a verse."""
    rows = markers(spark, folder, "pair", "verse", "word_idx", "source_tokens")
    each = rows.select("pair", "verse", "word_idx", F.posexplode("source_tokens").alias("i", "t")).filter(F.col("t.word").isNotNull())
    return each.select("pair", "verse", (F.shiftleft(F.col("word_idx").cast("bigint"), 32) + F.col("i")).alias("at"), F.col("t.word").alias("word"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, word, n): the words of the verses with their frequency."""
    return verse_words(spark, folder).groupBy("pair", "word").agg(F.count(F.lit(1)).alias("n"))


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries: (entry_id, pair, form, gloss, pos, count, allomorphs)."""
    rows = table(spark, folder, "lex_entries").select("entry_id", "updated_at", "pair", "form", "gloss", "pos", "count", "allomorphs")
    return live_rows(rows, "entry_id", "updated_at").drop("updated_at")


def affixes(spark: SparkSession, folder: str) -> DataFrame:
    """Live affixes: (affix_id, pair, form, gloss, kind, count, slot_ord, req_pos)."""
    rows = table(spark, folder, "affixes").select("affix_id", "updated_at", "pair", "form", "gloss", "kind", "count", "slot_ord", "req_pos")
    return live_rows(rows, "affix_id", "updated_at").drop("updated_at")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, word, line, forms, confidence, accepted): the distinct readings of words, as their morphs were marked.

    line and forms join glosses and forms in morph order; confidence is the
    highest lowest confidence of a morph over the reading's occurrences, accepted
    whether some occurrence has only accepted morphs.
    """
    rows = markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "word", "form", "gloss", "confidence", "decision")
    part = F.struct("morph_idx", F.coalesce("gloss", F.lit("?")).alias("g"), F.coalesce("form", F.lit("")).alias("f"), "marker_id")
    per = rows.groupBy("pair", "verse", "word_idx").agg(
        F.lower(F.min("word")).alias("word"), F.array_sort(F.collect_list(part)).alias("m"), F.min("confidence").alias("c"), F.min((F.coalesce("decision", F.lit("")) == "accept").cast("int")).alias("a")
    )
    lines = per.select("pair", "word", F.array_join(F.transform("m", lambda x: x["g"]), "-").alias("line"), F.array_join(F.transform("m", lambda x: x["f"]), "-").alias("forms"), "c", "a")
    named = lines.filter(F.col("word").isNotNull())
    return named.groupBy("pair", "word", "line").agg(F.min("forms").alias("forms"), F.coalesce(F.max("c"), F.lit(0.0)).alias("confidence"), (F.max("a") == 1).alias("accepted"))


# --- the same in DuckDB's SQL ------------------------------------------------------------------------------------

M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY loaded_at DESC) AS k FROM morph_markers) WHERE k = 1)"
W = "w AS (SELECT pair, verse, word_idx AS at_, lower(min(word)) AS word FROM m WHERE word IS NOT NULL GROUP BY pair, verse, word_idx)"
S = (
    "s AS (SELECT pair, verse, word_idx::BIGINT * 4294967296 + i - 1 AS at_, source_tokens[i].word AS word FROM "
    "(SELECT pair, verse, word_idx, source_tokens, unnest(generate_series(1, len(source_tokens))) AS i FROM m) WHERE source_tokens[i].word IS NOT NULL)"
)
V = "v AS (SELECT pair, word, count(*) AS n FROM w GROUP BY pair, word)"
L = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY updated_at DESC) AS k FROM lex_entries) WHERE k = 1)"
A = "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY affix_id ORDER BY updated_at DESC) AS k FROM affixes) WHERE k = 1)"
R = """r0 AS (
  SELECT pair, verse, word_idx, lower(min(word)) AS word,
    string_agg(coalesce(gloss, '?'), '-' ORDER BY morph_idx, coalesce(gloss, '?'), coalesce(form, ''), marker_id) AS line,
    string_agg(coalesce(form, ''), '-' ORDER BY morph_idx, coalesce(gloss, '?'), coalesce(form, ''), marker_id) AS forms,
    min(confidence) AS c, min(CASE WHEN coalesce(decision, '') = 'accept' THEN 1 ELSE 0 END) AS a
  FROM m GROUP BY pair, verse, word_idx),
r AS (SELECT pair, word, line, min(forms) AS forms, coalesce(max(c), 0.0) AS confidence, max(a) = 1 AS accepted
  FROM r0 WHERE word IS NOT NULL GROUP BY pair, word, line)"""


def with_(*parts: str, body: str) -> str:
    """A statement over the named relations."""
    return "WITH " + ",\n".join(parts) + "\n" + body
