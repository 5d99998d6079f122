"""Queries over gold relations, noun classes, dictionaries, allomorphy and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.functions import text as fx
from morphloom.operators import bilingual, classes, detect, gold, morph, paradigm, stats
from morphloom.operators.live import live_rows
from morphloom.plans import relations as r
from morphloom.plans.grammar import EDGE, KIND, MORPHS, NEAR
from morphloom.plans.relations import A, L, M, S, V, W, with_
from morphloom.plans.tables import table


def pos_votes(spark: SparkSession, folder: str) -> DataFrame:
    lex = r.lexicon(spark, folder).select("pair", F.col("form").alias("word"), "pos")
    marks = r.markers(spark, folder, "pair", "form", "pos", "type").filter("type = 'root'").select("pair", F.col("form").alias("word"), "pos")
    props = live_rows(table(spark, folder, "gemma_proposals"), "prop_id", "proposed_at").select("pair", "word", "pos")
    clean = lambda df: df.filter("word is not null")
    return gold.pos_votes([("lexicon", clean(lex)), ("markers", clean(marks)), ("proposals", clean(props))], ["pair"])


def nearest_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    lemmas = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("lemma"))
    return gold.nearest_lemma(r.vocabulary(spark, folder), lemmas, ["pair"])


def lemma_credit(spark: SparkSession, folder: str) -> DataFrame:
    lemmas = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("lemma"))
    fixes = r.affixes(spark, folder).filter("form is not null and kind in ('prefix', 'suffix')").select("pair", F.lower("form").alias("affix"), F.col("kind").alias("side"))
    return gold.lemma_credit(r.vocabulary(spark, folder), lemmas, fixes, ["pair"])


def allomorph_edits(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("form is not null").select("pair", "form", F.explode("allomorphs").alias("other")).filter("other is not null")
    edit = rows.select("pair", gold.inflection_edit(F.col("form"), F.col("other")).alias("e"))
    return edit.groupBy("pair", "e.kind", "e.remove", "e.add").agg(F.count(F.lit(1)).alias("n"))


def inflection_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("form is not null and pos <> ''").select("pair", F.col("form").alias("lemma"), F.col("pos").alias("features"), F.explode("allomorphs").alias("surface"))
    return gold.inflection_classes(rows.filter("surface is not null"), ["pair"], 12, 2)


def alignment_glosses(spark: SparkSession, folder: str) -> DataFrame:
    found = gold.alignment_glosses(r.verse_words(spark, folder), r.source_words(spark, folder), ["pair"], "verse")
    return found.select("pair", "stem", "source", "n", F.round("dice", 6).alias("dice"), "rank", F.round("margin", 6).alias("margin"))


def missing_concepts(spark: SparkSession, folder: str) -> DataFrame:
    source = r.source_words(spark, folder).groupBy("pair", F.col("word").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    lex = r.lexicon(spark, folder)
    known = lex.filter("gloss is not null").select("pair", F.col("gloss").alias("source"))
    best = gold.alignment_glosses(r.verse_words(spark, folder), r.source_words(spark, folder), ["pair"], "verse", 1, 1, 1.0, 99).select("pair", F.col("stem").alias("target"), "source")
    glossed = lex.filter("gloss is not null and form is not null").select("pair", F.lower("form").alias("target"))
    return gold.missing_concepts(source, known, best, glossed, ["pair"])


def gloss_constructs(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).filter("form is not null").select("pair", "gloss", "form", "count")
    fixes = r.affixes(spark, folder).filter("form is not null").select("pair", "gloss", "form", "kind", "count")
    return gold.gloss_index(roots, fixes, ["pair"])


def gloss_slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).select("pair", fx.gloss_slug(F.coalesce("gloss", F.lit(""))).alias("slug"), fx.is_grammatical(F.coalesce("gloss", F.lit(""))).alias("grammatical"))
    return rows.groupBy("pair", "slug", "grammatical").agg(F.count(F.lit(1)).alias("n"))


def induced_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return _induced(spark, folder)[0]


def induced_affixes(spark: SparkSession, folder: str) -> DataFrame:
    return _induced(spark, folder)[1]


def _induced(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = r.markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "form", "gloss").filter("form is not null and gloss is not null and verse is not null")
    one = rows.groupBy("pair", "verse", "word_idx", "morph_idx").agg(F.min(F.struct("form", "gloss")).alias("m"))
    return gold.build_model(one.select("pair", F.concat_ws("|", "verse", "word_idx").alias("word_id"), F.col("morph_idx").alias("at"), "m.form", "m.gloss"), ["pair"], 2)


def class_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return classes.class_prefixes(r.vocabulary(spark, folder), ["pair"], 3, 3, 1, 2)


def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return classes.class_pairs(r.vocabulary(spark, folder), class_prefixes(spark, folder).select("pair", "prefix"), ["pair"], 2)


def marker_votes(spark: SparkSession, folder: str) -> DataFrame:
    words = r.verse_words(spark, folder)
    top = r.vocabulary(spark, folder).filter("n >= 2")
    return classes.class_votes(words, ["pair"], ["verse"], "at", "word", top.select("pair", F.col("word").alias("noun")), top.select("pair", F.col("word").alias("marker")))


def carved_words(spark: SparkSession, folder: str) -> DataFrame:
    nouns = r.lexicon(spark, folder).filter("pos = 'noun' and form is not null").select("pair", F.lower("form").alias("noun"))
    return classes.carve(nouns, ["pair"], 3)


def dictionary_size(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("gloss is not null and form is not null").select(F.col("gloss").alias("reference"), F.concat_ws(":", "pair", "form").alias("vernacular"))
    return bilingual.dictionary_size(rows)


def complementary_affixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "form").filter("form is not null")
    morphs = rows.groupBy("pair", "verse", "word_idx", "morph_idx").agg(F.min("form").alias("form"))
    profiles = morph.environments(morphs, ["pair"], ["verse", "word_idx"], "morph_idx", "form", 8)
    found = paradigm.complementary(profiles, morph.near_forms(r.affixes(spark, folder), ["pair"]), ["pair"])
    return found.select("pair", "left", "right", "dimension", F.round("score", 6).alias("score"))


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Unexplained mass of each pair, by probe, as a work list."""
    lex, words = r.lexicon(spark, folder).filter("form is not null"), r.vocabulary(spark, folder)
    mass = detect.unexplained_mass(words, lex.select("pair", F.lower("form").alias("word")), ["pair"]).select("pair", F.lit("word_classes").alias("probe"), F.col("share").alias("unexplained"), F.lit(False).alias("proxy"))
    homo = detect.homograph_share(lex, ["pair"]).select("pair", F.lit("homographs").alias("probe"), F.col("share").alias("unexplained"), F.lit(False).alias("proxy"))
    redup = detect.reduplication_rates(words, ["pair"]).select("pair", F.lit("nonconcatenative").alias("probe"), F.coalesce("type_rate", F.lit(0.0)).alias("unexplained"), F.lit(True).alias("proxy"))
    probes = mass.unionByName(homo).unionByName(redup).withColumn("unexplained", F.round("unexplained", 6)).withColumn("ready", F.lit(True))
    return paradigm.frontier(probes, ["pair"]).withColumn("weight", F.round("weight", 6))


def hypothesis_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = live_rows(table(spark, folder, "tickets"), "id", "updated_at").select(F.col("id").alias("ticket"), F.posexplode("hypotheses").alias("at", "h")).filter("h is not null")
    assessed = rows.select("ticket", F.col("at").cast("string").alias("id"), F.col("h.verdict.acceptable").alias("acceptable"), F.try_element_at("h.metrics", F.lit("dmdl")).alias("delta_bits"), F.lit(None).cast("double").alias("overgeneration"), F.col("h.verdict.net").alias("net"))
    return paradigm.rank_hypotheses(assessed, ["ticket"]).select("ticket", F.col("id").cast("bigint").alias("hypothesis"), "place")


def shared_options(spark: SparkSession, folder: str) -> DataFrame:
    rows = live_rows(table(spark, folder, "tickets"), "id", "updated_at").select("type", F.explode("presentation_options").alias("o")).filter("o is not null and type is not null")
    return stats.modal(rows.select("type", F.col("o.question_id").alias("question")), ["type"], "question").select("type", "question", "n", "total", F.round("share", 6).alias("share"))


SPLIT = "x0 AS (SELECT DISTINCT pair, left(word, k) AS prefix, substr(word, k + 1) AS stem FROM (SELECT pair, word, unnest([1, 2, 3]) AS k FROM v) WHERE length(word) > 3 AND length(word) - k >= 3)"
LCP = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"
EDIT = f"""ed AS (SELECT pair, form, pos, other, {LCP.format(a="form", b="other")} AS h, {LCP.format(a="form", b="other").replace("left(", "right(")} AS t FROM (SELECT pair, form, pos, unnest(allomorphs) AS other FROM l WHERE form IS NOT NULL) WHERE other IS NOT NULL),
ee AS (SELECT pair, form, pos, CASE WHEN t > h THEN 'prefix' ELSE 'suffix' END AS kind, CASE WHEN t > h THEN left(form, length(form) - t) ELSE substr(form, h + 1) END AS remove,
  CASE WHEN t > h THEN left(other, length(other) - t) ELSE substr(other, h + 1) END AS add_ FROM ed)"""
ALIGN = """t0 AS (SELECT DISTINCT pair, verse, {stem} AS stem FROM w), s0 AS (SELECT DISTINCT pair, verse, word AS source FROM s),
rows_ AS (SELECT pair, count(DISTINCT verse) AS n FROM t0 GROUP BY 1), nt AS (SELECT pair, stem, count(*) AS n FROM t0 GROUP BY 1, 2 HAVING count(*) >= {least}),
ns AS (SELECT s0.pair, source, count(*) AS n FROM s0 JOIN rows_ USING (pair) GROUP BY 1, 2, rows_.n HAVING count(*) >= {least} AND count(*) <= {ceiling} * rows_.n),
al AS (SELECT *, row_number() OVER z AS rank, dice - coalesce(lead(dice) OVER z, 0) AS margin FROM (
  SELECT t0.pair, t0.stem, s0.source, count(*) AS n, 2.0::DOUBLE * count(*) / (nt.n + ns.n) AS dice FROM t0 JOIN nt ON nt.pair = t0.pair AND nt.stem = t0.stem
  JOIN s0 ON s0.pair = t0.pair AND s0.verse = t0.verse JOIN ns ON ns.pair = s0.pair AND ns.source = s0.source GROUP BY 1, 2, 3, nt.n, ns.n) WINDOW z AS (PARTITION BY pair, stem ORDER BY dice DESC, n DESC, source))"""
GRAM = "regexp_replace(gloss, '[0-9.\\s/()]', '', 'g')"

# a gloss of capitals, without digits, dots, blanks, slashes and brackets, is a label
INDUCED = """g0 AS (SELECT pair, verse || '|' || word_idx AS wid, morph_idx, min(struct_pack(f := form, g := gloss)) AS x FROM m WHERE form IS NOT NULL AND gloss IS NOT NULL AND verse IS NOT NULL GROUP BY pair, verse, word_idx, morph_idx),
g1 AS (SELECT pair, wid, morph_idx, x.f AS form, x.g AS gloss, regexp_replace(x.g, '[0-9.\\s/()]', '', 'g') AS b FROM g0),
g2 AS (SELECT *, b <> '' AND b = upper(b) AND upper(b) <> lower(b) AS gram FROM g1),
g3 AS (SELECT *, min(morph_idx) FILTER (NOT gram) OVER (PARTITION BY pair, wid) AS root_at FROM g2)"""

SQL = {
    "induced_lexicon": with_(M, INDUCED, body="""SELECT pair, form, gloss, count(*) AS "count" FROM g3 WHERE morph_idx = root_at GROUP BY 1, 2, 3"""),
    "induced_affixes": with_(M, INDUCED, body="""SELECT pair, form, gloss, kind, t AS "count" FROM (SELECT *, sum(n) OVER (PARTITION BY pair, form, gloss) AS t, row_number() OVER (PARTITION BY pair, form, gloss ORDER BY n DESC, kind) AS k FROM (
SELECT pair, form, gloss, CASE WHEN morph_idx < root_at THEN 'prefix' ELSE 'suffix' END AS kind, count(*) AS n FROM g3 WHERE gram AND root_at IS NOT NULL GROUP BY 1, 2, 3, 4)) WHERE k = 1 AND t >= 2"""),
    "pos_votes": with_(M, L, """q AS (SELECT DISTINCT pair, form AS word, pos, 0 AS rank FROM l WHERE form IS NOT NULL AND pos <> '' UNION ALL
SELECT DISTINCT pair, form, pos, 1 FROM m WHERE type = 'root' AND form IS NOT NULL AND pos <> '' UNION ALL
SELECT DISTINCT pair, word, pos, 2 FROM (SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY proposed_at DESC) AS k FROM gemma_proposals) WHERE k = 1 AND word IS NOT NULL AND pos <> '')""", body="""
SELECT pair, word, pos, votes, sources, conflict FROM (SELECT *, row_number() OVER (PARTITION BY pair, word ORDER BY votes DESC, rank, pos) AS k, count(*) OVER (PARTITION BY pair, word) > 1 AS conflict FROM (
SELECT pair, word, pos, count(DISTINCT rank) AS votes, min(rank) AS rank FROM q GROUP BY 1, 2, 3)) JOIN (SELECT pair, word, count(DISTINCT rank) AS sources FROM q GROUP BY 1, 2) USING (pair, word) WHERE k = 1"""),
    "nearest_lemmas": with_(M, W, V, L, body=f"""SELECT pair, word, lemma, shared FROM (SELECT *, row_number() OVER (PARTITION BY pair, word ORDER BY shared DESC, lemma) AS k FROM (
SELECT v.pair, word, lemma, {LCP.format(a="word", b="lemma")} AS shared FROM v JOIN (SELECT DISTINCT pair, lower(form) AS lemma FROM l WHERE form IS NOT NULL) x ON x.pair = v.pair AND left(word, 4) = left(lemma, 4)
WHERE length(word) >= 4 AND length(lemma) >= 4)) WHERE k = 1"""),
    "lemma_credit": with_(M, W, V, L, A, EDGE, body="""SELECT pair, lemma, sum(n) AS n FROM (SELECT DISTINCT pair, word, n, lemma FROM (SELECT pair, word, n, word AS lemma FROM v UNION ALL
SELECT e.pair, e.word, e.n, e.stem FROM e JOIN (SELECT DISTINCT pair, lower(form) AS affix, kind FROM a) f ON f.pair = e.pair AND f.affix = e.affix AND f.kind = e.side WHERE k <= 6 AND length(stem) >= 2)
WHERE (pair, lemma) IN (SELECT pair, lower(form) FROM l WHERE form IS NOT NULL)) GROUP BY 1, 2"""),
    "allomorph_edits": with_(L, EDIT, body='SELECT pair, kind, remove, add_ AS "add", count(*) AS n FROM ee GROUP BY 1, 2, 3, 4'),
    "inflection_classes": with_(L, EDIT, """ch AS (SELECT pair, form, pos, pos || ':' || kind || '-' || remove || '+' || add_ AS c FROM ee WHERE pos <> ''),
top AS (SELECT pair, pos FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, pos) AS k FROM (SELECT pair, pos, count(DISTINCT form) AS n FROM ch GROUP BY 1, 2)) WHERE k <= 12)""", body="""
SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY size DESC, signature) AS class_id, size, signature FROM (SELECT pair, signature, count(*) AS size FROM (
SELECT pair, form, array_to_string(list_sort(list(DISTINCT c)), ' ') AS signature FROM ch JOIN top USING (pair, pos) GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) >= 2)"""),
    "alignment_glosses": with_(M, W, S, ALIGN.format(stem="CASE WHEN length(word) >= 5 THEN left(word, 5) ELSE word END", least=2, ceiling=0.4), body="SELECT pair, stem, source, n, round(dice, 6) AS dice, rank, round(margin, 6) AS margin FROM al WHERE rank <= 5"),
    "missing_concepts": with_(M, W, S, L, ALIGN.format(stem="word", least=1, ceiling=1.0), body="""SELECT pair, source, n, candidates FROM (SELECT pair, word AS source, count(*) AS n FROM s GROUP BY 1, 2)
JOIN (SELECT pair, source, count(DISTINCT stem) AS candidates FROM al WHERE rank = 1 AND (pair, stem) NOT IN (SELECT pair, lower(form) FROM l WHERE gloss IS NOT NULL AND form IS NOT NULL) GROUP BY 1, 2) USING (pair, source)
WHERE (pair, source) NOT IN (SELECT pair, gloss FROM l WHERE gloss IS NOT NULL)"""),
    "gloss_constructs": with_(L, A, body="""SELECT pair, gloss, form, kind, "count" FROM (SELECT *, row_number() OVER (PARTITION BY pair, gloss ORDER BY kind <> 'root', "count" DESC NULLS LAST, form, kind) AS z FROM (
SELECT pair, gloss, form, 'root' AS kind, "count" FROM l UNION ALL SELECT pair, gloss, form, kind, "count" FROM a) WHERE gloss IS NOT NULL AND gloss <> '?' AND form IS NOT NULL) WHERE z = 1"""),
    "gloss_slugs": with_(L, body="""SELECT pair, slug, grammatical, count(*) AS n FROM (SELECT pair, coalesce(nullif(regexp_replace(trim(regexp_extract(coalesce(gloss, ''), '^([^;,(]*)', 1)), '\\s+', '_', 'g'), ''), '?') AS slug,
b <> '' AND b = upper(b) AND upper(b) <> lower(b) AS grammatical FROM (SELECT *, regexp_replace(coalesce(gloss, ''), '[0-9.\\s/()]', '', 'g') AS b FROM l)) GROUP BY 1, 2, 3"""),
    "class_prefixes": with_(M, W, V, SPLIT, """x1 AS (SELECT * FROM x0 WHERE (pair, prefix) IN (SELECT pair, prefix FROM x0 GROUP BY 1, 2 HAVING count(*) >= 3))""", body="""
SELECT pair, prefix, count(*) AS stems FROM (SELECT p.pair, p.prefix, p.stem, count(*) AS others FROM x1 p JOIN x1 q ON q.pair = p.pair AND q.stem = p.stem AND q.prefix <> p.prefix AND NOT starts_with(q.prefix, p.prefix) AND NOT starts_with(p.prefix, q.prefix)
GROUP BY 1, 2, 3) WHERE others >= 1 GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "marker_votes": with_(M, W, V, body="""SELECT pair, noun, marker, count(*) AS n FROM (SELECT pair, word AS noun, lead(word) OVER (PARTITION BY pair, verse ORDER BY at_) AS marker FROM w)
WHERE (pair, noun) IN (SELECT pair, word FROM v WHERE n >= 2) AND (pair, marker) IN (SELECT pair, word FROM v WHERE n >= 2) GROUP BY 1, 2, 3"""),
    "dictionary_size": with_(L, body="""SELECT sum(n)::BIGINT AS entries, count(*) AS "references", (SELECT count(DISTINCT pair || ':' || form) FROM l WHERE gloss IS NOT NULL AND form IS NOT NULL) AS vernaculars, count(*) FILTER (n > 1) AS ambiguous
FROM (SELECT gloss, count(DISTINCT pair || ':' || form) AS n FROM l WHERE gloss IS NOT NULL AND form IS NOT NULL GROUP BY 1)"""),
    "complementary_affixes": with_(M, A, MORPHS, f"nr AS ({NEAR.format(t='a')})", f"""en AS (SELECT pair, form, dimension, bucket, n / sum(n) FILTER (bucket <> '#') OVER (PARTITION BY pair, form, dimension) AS p FROM (
SELECT *, sum(n) OVER (PARTITION BY pair, form, dimension) AS t FROM (SELECT pair, form, dimension, bucket, count(*) AS n FROM (
  SELECT pair, form, 'right' AS dimension, {KIND.format(x="y", f="left")} AS bucket FROM (SELECT *, lead(form) OVER (PARTITION BY pair, verse, word_idx ORDER BY morph_idx) AS y FROM o)
  UNION ALL SELECT pair, form, 'left', {KIND.format(x="y", f="right")} FROM (SELECT *, lag(form) OVER (PARTITION BY pair, verse, word_idx ORDER BY morph_idx) AS y FROM o)) GROUP BY ALL)) WHERE t >= 8 AND bucket <> '#'),
sc AS (SELECT nr.pair, nr."left", nr."right", d.dimension, 1 - coalesce((SELECT sum(least(x.p, y.p)) FROM en x JOIN en y ON x.pair = y.pair AND x.dimension = y.dimension AND x.bucket = y.bucket
  WHERE x.pair = nr.pair AND x.form = nr."left" AND y.form = nr."right" AND x.dimension = d.dimension), 0) AS score FROM nr
  JOIN (SELECT DISTINCT pair, form, dimension FROM en) d ON d.pair = nr.pair AND d.form = nr."left" JOIN (SELECT DISTINCT pair, form, dimension FROM en) e ON e.pair = nr.pair AND e.form = nr."right" AND e.dimension = d.dimension)""", body="""
SELECT nr.pair, nr."left", nr."right", coalesce(b.dimension, '') AS dimension, round(coalesce(b.score, 0.0), 6) AS score FROM nr
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pair, "left", "right" ORDER BY round(score, 12) DESC, dimension DESC) AS k FROM sc) b ON b.pair = nr.pair AND b."left" = nr."left" AND b."right" = nr."right" AND b.k = 1"""),
    "hypothesis_ranks": """SELECT ticket, hypothesis, row_number() OVER (PARTITION BY ticket ORDER BY acceptable DESC NULLS LAST, d ASC NULLS LAST, net DESC NULLS LAST, hypothesis::VARCHAR) AS place FROM (
SELECT id AS ticket, i - 1 AS hypothesis, hypotheses[i].verdict.acceptable AS acceptable, hypotheses[i].metrics['dmdl'] AS d, hypotheses[i].verdict.net AS net FROM (SELECT id, hypotheses, unnest(generate_series(1, len(hypotheses))) AS i FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM tickets) WHERE k = 1) WHERE hypotheses[i] IS NOT NULL)""",
    "shared_options": """SELECT type, question, n, total, round(n / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY type) AS total, row_number() OVER (PARTITION BY type ORDER BY n DESC, question) AS p FROM (
SELECT type, o.question_id AS question, count(*) AS n FROM (SELECT type, unnest(presentation_options) AS o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM tickets) WHERE k = 1)
WHERE o IS NOT NULL AND type IS NOT NULL AND o.question_id IS NOT NULL GROUP BY 1, 2)) WHERE p = 1""",
}

QUERIES = {f.__name__: f for f in (
    pos_votes, nearest_lemmas, lemma_credit, allomorph_edits, inflection_classes, alignment_glosses, missing_concepts, gloss_constructs, gloss_slugs, induced_lexicon, induced_affixes,
    class_prefixes, class_pairs, marker_votes, carved_words, dictionary_size, complementary_affixes, frontier, hypothesis_ranks, shared_options,
)}
