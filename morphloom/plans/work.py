"""Queries over hypotheses, edits as changes, and selections for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.operators import hypotheses as hy
from morphloom.operators.live import live_rows
from morphloom.plans import relations as r
from morphloom.plans.grammar import EDGE
from morphloom.plans.induction import AF, KN
from morphloom.plans.relations import A, L, M, V, W, with_
from morphloom.plans.tables import table


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lemmas = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("lemma"))
    fixes = r.affixes(spark, folder).filter("form <> '' and kind in ('prefix', 'suffix')").select("pair", F.col("kind").alias("side"), F.lower("form").alias("affix"))
    return r.vocabulary(spark, folder), lemmas, fixes


def decompositions(spark: SparkSession, folder: str) -> DataFrame:
    return hy.decompositions(*_parts(spark, folder), ["pair"])


def word_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    found = hy.hypotheses(*_parts(spark, folder), ["pair"])
    return found.groupBy("pair", "mechanism").agg(F.countDistinct("word").alias("words"), F.count(F.lit(1)).alias("n"))


def _edits(spark: SparkSession, folder: str, kept: str) -> DataFrame:
    rows = live_rows(table(spark, folder, "tickets"), "id", "updated_at").select("id", "pair", F.posexplode("hypotheses").alias("h_at", "h")).filter(kept)
    each = rows.select("id", "pair", "h_at", F.posexplode("h.edits").alias("at", "e")).filter("e is not null")
    return hy.flat_edits(each.select("id", "pair", "h_at", F.col("at").alias("ordinal"), "e.kind", "e.params"), ["id", "pair", "h_at"])


def edit_changes(spark: SparkSession, folder: str) -> DataFrame:
    found = hy.edits_to_changes(_edits(spark, folder, "h.verdict.acceptable"), ["pair"], "pair")
    return found.groupBy("pair", "op", "key", "gloss", "pos", "gram", "kind", "rationale").agg(F.count(F.lit(1)).alias("n"))


def quota_words(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("word")
    staged = r.vocabulary(spark, folder).withColumn("stage", F.when(size <= 4, "short").when(size <= 8, "medium").otherwise("long"))
    return hy.quota(staged, ["pair"], "stage", [F.desc("n"), F.asc("word")], {"short": 2, "medium": 3}).select("pair", "stage", "word", "n")


def option_effects(spark: SparkSession, folder: str) -> DataFrame:
    read = r.readings(spark, folder)
    options = read.filter("confidence >= 0.8").select("pair", F.lit("sure").alias("option"), "word").unionByName(read.filter("confidence < 0.8").select("pair", F.lit("unsure").alias("option"), "word"))
    return hy.compare_options(read.filter("accepted").select("pair", "word"), options, ["pair"])


EDITS = """RECURSIVE e0 AS (SELECT pair, e.kind AS kind, e.params::JSON AS params FROM (SELECT pair, unnest(h.edits) AS e FROM (SELECT pair, unnest(hypotheses) AS h FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM tickets) WHERE k = 1) WHERE h.verdict.acceptable) WHERE e IS NOT NULL),
e1 AS (SELECT pair, kind, params FROM e0 UNION ALL
  SELECT pair, json_extract_string(x, '$.kind'), json_extract(x, '$.params') FROM (SELECT pair, unnest(from_json(json_extract(params, '$.edits'), '["JSON"]')) AS x FROM e1 WHERE kind = 'resegment' AND json_type(params, '$.edits') = 'ARRAY')),
ed AS (SELECT pair, kind, json_extract_string(params, '$.form') AS form, json_extract_string(params, '$.gloss') AS gloss, json_extract_string(params, '$.pos') AS pos, params FROM e1),
ch AS (
  SELECT pair, 'lexical.entry.create' AS op, pair || '=' || form AS key, NULL::VARCHAR AS gloss, NULL::VARCHAR AS pos, NULL::VARCHAR AS gram, NULL::VARCHAR AS kind, NULL::VARCHAR AS rationale FROM ed WHERE kind IN ('add_lexentry', 'split_homograph')
  UNION ALL SELECT pair, 'lexical.sense.create', 'entry:' || pair || ':' || form, gloss, NULL, NULL, NULL, NULL FROM ed WHERE kind IN ('add_lexentry', 'split_homograph') AND gloss NOT IN ('', '?')
  UNION ALL SELECT pair, 'lexical.entry.set_pos', 'entry:' || pair || ':' || form, NULL, pos, NULL, NULL, NULL FROM ed WHERE kind IN ('add_lexentry', 'split_homograph') AND pos <> ''
  UNION ALL SELECT pair, 'lexical.entry.add_allomorph', json_extract_string(params, '$.allomorph'), NULL, NULL, NULL, NULL, NULL FROM ed WHERE kind = 'add_allomorph'
  UNION ALL SELECT pair, 'morphophonology.affix.add', form, NULL, NULL, coalesce(gloss, form), coalesce(json_extract_string(params, '$.kind'), 'suffix'), NULL FROM ed WHERE kind = 'add_affix'
  UNION ALL SELECT pair, 'morphophonology.rule.add', coalesce(json_extract_string(params, '$.id'), 'rule'), NULL, NULL, coalesce(json_extract_string(params, '$.archiphoneme'), json_extract_string(params, '$.xml'), 'rule'), NULL, NULL FROM ed WHERE kind = 'add_phon_rule'
  UNION ALL SELECT pair, 'morphophonology.affix.add', form, NULL, NULL, coalesce(gloss, form), NULL, 'REPAIR/' || kind || ': review manually' FROM ed WHERE kind IN ('narrow_affix', 'retract_affix'))"""

SQL = {
    "decompositions": with_(M, W, V, L, A, AF, KN, EDGE, body="""SELECT DISTINCT e.pair, e.word, e.stem AS lemma, e.side, e.affix FROM e JOIN af ON af.pair = e.pair AND af.side = e.side AND af.affix = e.affix
WHERE e.k <= 6 AND length(e.stem) >= 2 AND (e.pair, e.stem) IN (SELECT pair, word FROM kn)"""),
    "edit_changes": with_(EDITS, body="SELECT pair, op, key, gloss, pos, gram, kind, rationale, count(*) AS n FROM ch WHERE key <> '' GROUP BY ALL"),
    "quota_words": with_(M, W, V, body="""SELECT pair, stage, word, n FROM (SELECT *, row_number() OVER (PARTITION BY pair, stage ORDER BY n DESC, word) AS p FROM (
SELECT *, CASE WHEN length(word) <= 4 THEN 'short' WHEN length(word) <= 8 THEN 'medium' ELSE 'long' END AS stage FROM v)) WHERE p <= CASE stage WHEN 'short' THEN 2 WHEN 'medium' THEN 3 ELSE 0 END"""),
    "option_effects": with_(M, r.R, """b AS (SELECT DISTINCT pair, word FROM r WHERE accepted), o AS (SELECT DISTINCT pair, CASE WHEN confidence >= 0.8 THEN 'sure' ELSE 'unsure' END AS option, word FROM r)""", body="""
SELECT x.pair, x.option, x.words, x.gained, coalesce(y.lost, 0) AS lost FROM (SELECT o.pair, o.option, count(*) AS words, count(*) FILTER (b.word IS NULL) AS gained FROM o LEFT JOIN b ON b.pair = o.pair AND b.word = o.word GROUP BY 1, 2) x
LEFT JOIN (SELECT n.pair, n.option, count(*) AS lost FROM (SELECT DISTINCT pair, option FROM o) n JOIN b ON b.pair = n.pair WHERE (n.pair, n.option, b.word) NOT IN (SELECT pair, option, word FROM o) GROUP BY 1, 2) y ON y.pair = x.pair AND y.option = x.option"""),
}

QUERIES = {f.__name__: f for f in (decompositions, word_hypotheses, edit_changes, quota_words, option_effects)}
