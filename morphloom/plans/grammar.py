"""Queries over morphology: induction from distribution, parsing, assessment, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.operators import assess, detect, morph
from morphloom.plans import relations as r
from morphloom.plans.relations import A, L, M, R, V, W, with_


def edge_affixes(spark: SparkSession, folder: str) -> DataFrame:
    return morph.attested_affixes(r.vocabulary(spark, folder), ["pair"], "word", stems=3)


def signature_affixes(spark: SparkSession, folder: str) -> DataFrame:
    return morph.signature_affixes(r.vocabulary(spark, folder), ["pair"], "word", stems=5)


def longest_suffix(spark: SparkSession, folder: str) -> DataFrame:
    known = r.affixes(spark, folder).filter("kind = 'suffix' and form is not null").select("pair", F.lower("form").alias("affix"))
    return morph.longest_edge(r.vocabulary(spark, folder), ["pair"], "word", known, "suffix")


def residues(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("root"))
    return morph.affix_candidates(r.vocabulary(spark, folder), roots, ["pair"])


def open_residues(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("root"))
    known = r.affixes(spark, folder).filter("form <> ''").select("pair", F.col("kind").alias("side"), F.lower("form").alias("residue"))
    return morph.open_residues(r.vocabulary(spark, folder), roots, known, ["pair"])


def affix_families(spark: SparkSession, folder: str) -> DataFrame:
    return morph.harmony_families(r.affixes(spark, folder), ["pair"])


def stem_classes(spark: SparkSession, folder: str) -> DataFrame:
    words = r.vocabulary(spark, folder)
    split = morph.edges(words.select("pair", "word"), ["pair"], "word", 3, 3)
    good = morph.signature_affixes(words, ["pair"], "word", stems=5, longest=3)
    return morph.stem_classes(split.join(good.select("pair", "side", "affix"), ["pair", "side", "affix"]), ["pair"], 2, 3)


def near_affixes(spark: SparkSession, folder: str) -> DataFrame:
    return morph.near_forms(r.affixes(spark, folder), ["pair"])


def near_roots(spark: SparkSession, folder: str) -> DataFrame:
    return morph.near_forms(r.lexicon(spark, folder), ["pair"])


def _morphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "form", "type").filter("form is not null")
    return rows.groupBy("pair", "verse", "word_idx", "morph_idx").agg(F.min("form").alias("form"))


def environments(spark: SparkSession, folder: str) -> DataFrame:
    return morph.environments(_morphs(spark, folder), ["pair"], ["verse", "word_idx"], "morph_idx", "form")


def affix_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "form", "type", "slot").filter("form is not null and type <> 'root'")
    return morph.slot_order(rows, ["pair"], "form", "type", "slot")


def parsed_words(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).select(F.col("pair").alias("space"), F.lower("form").alias("form"), "gloss")
    fixes = r.affixes(spark, folder).select(F.col("pair").alias("space"), F.lower("form").alias("form"), "gloss", "kind")
    return morph.parse_words(r.vocabulary(spark, folder), "pair", "word", roots, fixes)


def parse_coverage(spark: SparkSession, folder: str) -> DataFrame:
    parses = parsed_words(spark, folder).withColumnRenamed("space", "pair")
    found = assess.coverage(r.vocabulary(spark, folder), parses, ["pair"])
    return found.select("pair", "types", "parsed", F.round("type_coverage", 6).alias("type_coverage"), F.round("token_coverage", 6).alias("token_coverage"))


def bpe_merges(spark: SparkSession, folder: str) -> DataFrame:
    words = morph.merged_words(r.vocabulary(spark, folder), ["pair"], 300)
    return words.select("pair", "word", F.array_join("symbols", " ").alias("symbols"))


def reading_coverage(spark: SparkSession, folder: str) -> DataFrame:
    accepted = r.readings(spark, folder).filter("accepted").withColumn("analysis", F.lit(1))
    found = assess.coverage(r.vocabulary(spark, folder), accepted, ["pair"])
    return found.select("pair", "types", "parsed", F.round("type_coverage", 6).alias("type_coverage"), F.round("token_coverage", 6).alias("token_coverage"))


def reading_ambiguity(spark: SparkSession, folder: str) -> DataFrame:
    found = assess.ambiguity(r.readings(spark, folder), ["pair"])
    return found.select("pair", *[F.round(c, 6).alias(c) for c in ("mean", "rate", "geometric_mean")])


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return r.readings(spark, folder).filter("accepted").select("pair", "word", "line")


def reading_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    found = assess.roundtrip(r.readings(spark, folder).filter("confidence >= 0.8"), _gold(spark, folder), ["pair"])
    return found.select("pair", "gold", "found", F.round("recall", 6).alias("recall"))


def reading_overgeneration(spark: SparkSession, folder: str) -> DataFrame:
    found = assess.overgeneration(r.readings(spark, folder), _gold(spark, folder), ["pair"])
    return found.select("pair", "readings", "spurious", F.round("rate", 6).alias("rate"))


def reading_regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.readings(spark, folder)
    return assess.non_regression(rows.filter("confidence >= 0.5 and confidence < 0.9"), rows.filter("confidence >= 0.7"), _gold(spark, folder), ["pair"])


def boundary_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.readings(spark, folder)
    one = lambda df: df.groupBy("pair", "word").agg(F.min("forms").alias("forms"))
    found = assess.boundary_scores(one(rows), one(rows.filter("accepted")), ["pair"])
    return found.select("pair", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def dead_affixes(spark: SparkSession, folder: str) -> DataFrame:
    used = r.markers(spark, folder, "pair", "gloss", "type").filter("type <> 'root' and gloss is not null")
    return assess.dead_constructs(r.affixes(spark, folder).filter("gloss is not null"), used, ["pair"])


def tolerated_allomorphy(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("pos <> ''").groupBy("pair", "pos").agg(F.count(F.lit(1)).alias("items"), F.sum(F.when(F.size("allomorphs") > 0, 1).otherwise(0)).alias("exceptions"))
    return rows.withColumn("productive", assess.tolerance(F.col("items"), F.col("exceptions")))


def _grammar(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    roots = r.lexicon(spark, folder).select("pair", "form", "pos")
    return roots, r.affixes(spark, folder).select("pair", "form", F.col("slot_ord").alias("slot"))


def grammar_bits(spark: SparkSession, folder: str) -> DataFrame:
    return assess.grammar_length(*_grammar(spark, folder), ["pair"]).select("pair", F.round("bits", 3).alias("bits"))


def corpus_bits(spark: SparkSession, folder: str) -> DataFrame:
    words = r.vocabulary(spark, folder)
    letters = words.select("pair", F.explode(F.regexp_extract_all("word", F.lit("(?s)."), 0)).alias("c")).groupBy("pair").agg(F.greatest(F.countDistinct("c"), F.lit(2)).alias("sigma"))
    read = r.readings(spark, folder)
    return assess.data_length(words, read, letters, ["pair"], read.filter("accepted")).select("pair", F.round("bits", 3).alias("bits"))


def worst_constructs(spark: SparkSession, folder: str) -> DataFrame:
    return assess.worst_parts(r.readings(spark, folder), _gold(spark, folder), ["pair"])


def ablated_root(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("form is not null and count is not null")
    return assess.ablation(rows, ["pair"], "count", ["form", "entry_id"], 3).select("pair", "entry_id", "form", "count")


def affix_polarity(spark: SparkSession, folder: str) -> DataFrame:
    return detect.affix_polarity(r.affixes(spark, folder), ["pair"])


def reduplication(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.reduplication_rates(r.vocabulary(spark, folder), ["pair"])
    return found.select("pair", "types", "redup_types", F.round("type_rate", 6).alias("type_rate"), F.round("token_rate", 6).alias("token_rate"))


def infix_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return detect.infixes(r.vocabulary(spark, folder), ["pair"], 2)


def syllables(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.syllable_stats(r.vocabulary(spark, folder), ["pair"])
    return found.select("pair", "words", F.round("mean", 6).alias("mean"), F.round("monosyllables", 6).alias("monosyllables"))


def unexplained_words(spark: SparkSession, folder: str) -> DataFrame:
    known = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("word"))
    found = detect.unexplained_mass(r.vocabulary(spark, folder), known, ["pair"])
    return found.select("pair", "tokens", "unknown", F.round("share", 6).alias("share"))


def homographs(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.homograph_share(r.lexicon(spark, folder), ["pair"])
    return found.select("pair", "forms", "homographs", F.round("share", 6).alias("share"))


def feature_loci(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "type", "features").filter("type <> 'root'")
    return rows.select("pair", "type", F.explode("features").alias("name", "value")).groupBy("pair", "type", "name").agg(F.count(F.lit(1)).alias("n"))


EDGE = """e AS (SELECT pair, word, n, side, CASE side WHEN 'prefix' THEN left(word, k) ELSE right(word, k) END AS affix,
  CASE side WHEN 'prefix' THEN substr(word, k + 1) ELSE left(word, length(word) - k) END AS stem, k
  FROM (SELECT v.*, unnest(range(1, length(word))) AS k FROM v) x, (VALUES ('prefix'), ('suffix')) t(side))"""
SIG = """q AS (SELECT DISTINCT pair, side, affix, stem FROM e WHERE k <= {longest} AND length(stem) >= 3),
fan AS (SELECT pair, side, stem, count(*) AS n FROM q GROUP BY 1, 2, 3),
sig AS (SELECT q.pair, q.side, q.affix, count(*) AS stems FROM q JOIN fan USING (pair, side, stem) LEFT JOIN v ON v.pair = q.pair AND v.word = q.stem
  WHERE v.word IS NOT NULL OR fan.n >= 2 GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""
MORPHS = "o AS (SELECT pair, verse, word_idx, morph_idx, min(form) AS form FROM m WHERE form IS NOT NULL GROUP BY 1, 2, 3, 4)"
GOLD = "gold AS (SELECT pair, word, line FROM r WHERE accepted)"
KIND = "CASE WHEN {x} IS NULL THEN '#' WHEN translate(lower({f}({x}, 1)), 'aeiou', '') = '' THEN 'V' ELSE 'C' END"
NEAR = """SELECT x.pair, x.form AS "left", y.form AS "right" FROM (SELECT DISTINCT pair, form FROM {t} WHERE form <> '') x JOIN (SELECT DISTINCT pair, form FROM {t} WHERE form <> '') y
ON x.pair = y.pair AND x.form < y.form AND abs(length(x.form) - length(y.form)) <= 1 WHERE len(list_filter(generate_series(0, least(length(x.form), length(y.form))), lambda i: left(x.form, i) = left(y.form, i) AND
(substr(x.form, i + 2) = substr(y.form, i + 2) OR substr(x.form, i + 1) = substr(y.form, i + 2) OR substr(x.form, i + 2) = substr(y.form, i + 1)))) > 0"""
VOWELS = "aeiouáéíóúàèìòùâêîôûäëïöüāēīōūɛɔəạọ"
CHARS = "list_filter(string_split({0}, ''), lambda c: c <> '')"

SQL = {
    "edge_affixes": with_(M, W, V, EDGE, body="""SELECT e.pair, side, affix, count(DISTINCT stem) AS stems FROM e JOIN v ON v.pair = e.pair AND v.word = e.stem
WHERE k BETWEEN 2 AND 5 GROUP BY 1, 2, 3 HAVING count(DISTINCT stem) >= 3"""),
    "signature_affixes": with_(M, W, V, EDGE, SIG.format(longest=5), body="SELECT pair, side, affix, stems FROM sig"),
    "stem_classes": with_(M, W, V, EDGE, SIG.format(longest=3), body="""SELECT pair, signature, count(*) AS stems FROM (
SELECT pair, stem, list_sort(list(DISTINCT CASE side WHEN 'prefix' THEN affix || '-' ELSE '-' || affix END)) AS s, array_to_string(s, ' ') AS signature
FROM e JOIN sig USING (pair, side, affix) WHERE k <= 3 AND length(stem) >= 3 GROUP BY 1, 2) WHERE len(s) >= 2 GROUP BY 1, 2 HAVING count(*) >= 3"""),
    "longest_suffix": with_(M, W, V, EDGE, A, body="""SELECT pair, word, affix, stem FROM (SELECT e.*, row_number() OVER (PARTITION BY e.pair, word ORDER BY length(e.affix) DESC) AS p
FROM e JOIN (SELECT DISTINCT pair, lower(form) AS affix FROM a WHERE kind = 'suffix' AND form IS NOT NULL) f ON f.pair = e.pair AND f.affix = e.affix
WHERE side = 'suffix' AND e.k <= 6 AND length(stem) >= 2) WHERE p = 1"""),
    "residues": with_(M, W, V, EDGE, L, body="""SELECT pair, side, residue, sum(n) AS n FROM (
SELECT e.pair, word, n, CASE side WHEN 'prefix' THEN 'suffix' ELSE 'prefix' END AS side, stem AS residue, row_number() OVER (PARTITION BY e.pair, word, e.side ORDER BY length(affix) DESC) AS p
FROM e JOIN (SELECT DISTINCT pair, lower(form) AS root FROM l WHERE form IS NOT NULL) x ON x.pair = e.pair AND x.root = e.affix WHERE length(affix) >= 3)
WHERE p = 1 AND length(residue) <= 4 GROUP BY 1, 2, 3"""),
    "affix_families": with_(A, body="""SELECT pair, skeleton, len(m) AS forms, array_to_string(m, ' ') AS members FROM (
SELECT pair, translate(form, 'aeiouáéíóú', '') AS skeleton, list_sort(list(DISTINCT form)) AS m FROM a WHERE form IS NOT NULL GROUP BY 1, 2) WHERE len(m) >= 2"""),
    "near_affixes": with_(A, body=NEAR.format(t="a")),
    "near_roots": with_(L, body=NEAR.format(t="l")),
    "environments": with_(M, MORPHS, body=f"""SELECT pair, form, dimension, bucket, n FROM (SELECT *, sum(n) OVER (PARTITION BY pair, form, dimension) AS t FROM (
SELECT pair, form, dimension, bucket, count(*) AS n FROM (
  SELECT pair, form, 'right' AS dimension, {KIND.format(x="y", f="left")} AS bucket FROM (SELECT *, lead(form) OVER (PARTITION BY pair, verse, word_idx ORDER BY morph_idx) AS y FROM o)
  UNION ALL SELECT pair, form, 'left', {KIND.format(x="y", f="right")} FROM (SELECT *, lag(form) OVER (PARTITION BY pair, verse, word_idx ORDER BY morph_idx) AS y FROM o)) GROUP BY ALL)) WHERE t >= 8"""),
    "affix_slots": with_(M, body="""SELECT pair, form, type, slot, n FROM (SELECT *, row_number() OVER (PARTITION BY pair, form, type ORDER BY n DESC, slot) AS p FROM (
SELECT pair, form, type, slot, count(*) AS n FROM m WHERE form IS NOT NULL AND type <> 'root' GROUP BY 1, 2, 3, 4)) WHERE p = 1 AND n >= 2"""),
    "reading_coverage": with_(M, W, V, R, body="""SELECT v.pair, count(*) AS types, count(h.word) AS parsed, round(count(h.word) / count(*), 6) AS type_coverage, round(sum(CASE WHEN h.word IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS token_coverage
FROM v LEFT JOIN (SELECT DISTINCT pair, word FROM r WHERE accepted) h ON h.pair = v.pair AND h.word = v.word GROUP BY v.pair"""),
    "reading_ambiguity": with_(M, R, body="""SELECT pair, round(avg(n), 6) AS mean, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) AS rate, round(exp(avg(ln(n))), 6) AS geometric_mean
FROM (SELECT pair, word, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY pair"""),
    "reading_roundtrip": with_(M, R, GOLD, body="""SELECT gold.pair, count(*) AS gold, count(h.line) AS found, round(count(h.line) / count(*), 6) AS recall
FROM gold LEFT JOIN (SELECT DISTINCT pair, word, line FROM r WHERE confidence >= 0.8) h USING (pair, word, line) GROUP BY 1"""),
    "reading_overgeneration": with_(M, R, GOLD, body="""SELECT r.pair, count(*) AS readings, count(*) FILTER (g.line IS NULL) AS spurious, round(count(*) FILTER (g.line IS NULL) / count(*), 6) AS rate
FROM r JOIN (SELECT DISTINCT pair, word FROM gold) x ON x.pair = r.pair AND x.word = r.word LEFT JOIN gold g ON g.pair = r.pair AND g.word = r.word AND g.line = r.line GROUP BY 1"""),
    "reading_regression": with_(M, R, GOLD, """b AS (SELECT pair, word, line FROM r WHERE confidence >= 0.5 AND confidence < 0.9), f AS (SELECT pair, word, line FROM r WHERE confidence >= 0.7),
lost AS (SELECT pair, count(*) AS n FROM (SELECT * FROM gold INTERSECT SELECT * FROM b EXCEPT SELECT * FROM f) GROUP BY 1),
new AS (SELECT pair, count(*) AS n FROM (SELECT * FROM f WHERE (pair, word) IN (SELECT pair, word FROM gold) EXCEPT SELECT * FROM gold EXCEPT SELECT * FROM b) GROUP BY 1)""",
        body="SELECT p.pair, coalesce(lost.n, 0) AS lost, coalesce(new.n, 0) AS spurious FROM (SELECT DISTINCT pair FROM gold) p LEFT JOIN lost USING (pair) LEFT JOIN new USING (pair)"),
    "boundary_scores": with_(M, R, """cut AS (SELECT pair, word, accepted, list_transform(range(1, len(x)), lambda i: list_sum(x[1:i])) AS b FROM (
SELECT pair, word, accepted, list_transform(string_split(min(forms), '-'), lambda q: length(q)) AS x FROM (SELECT pair, word, forms, false AS accepted FROM r UNION ALL SELECT pair, word, forms, true FROM r WHERE accepted) GROUP BY ALL))
""".replace(" GROUP BY ALL", " GROUP BY pair, word, accepted"), body="""SELECT pair, hits, round(hits / nullif(np, 0), 6) AS precision, round(hits / nullif(ng, 0), 6) AS recall, round(2.0 * hits / nullif(np + ng, 0), 6) AS f1 FROM (
SELECT p.pair, sum(len(list_intersect(p.b, coalesce(g.b, [])))) AS hits, sum(len(p.b)) AS np, sum(len(coalesce(g.b, []))) AS ng
FROM (SELECT * FROM cut WHERE NOT accepted) p LEFT JOIN (SELECT * FROM cut WHERE accepted) g ON g.pair = p.pair AND g.word = p.word GROUP BY 1)"""),
    "dead_affixes": with_(M, A, body="SELECT pair, gloss FROM a WHERE gloss IS NOT NULL EXCEPT SELECT pair, gloss FROM m WHERE type <> 'root'"),
    "tolerated_allomorphy": with_(L, body="""SELECT pair, pos, count(*) AS items, count(*) FILTER (len(allomorphs) > 0) AS exceptions,
CASE WHEN count(*) >= 2 THEN count(*) FILTER (len(allomorphs) > 0) <= count(*) / ln(count(*)) END AS productive FROM l WHERE pos <> '' GROUP BY 1, 2"""),
    "grammar_bits": with_(L, A, body=f"""SELECT c.pair, round((coalesce(r.x, 0) + coalesce(f.x, 0)) * log2(sigma + 1) + coalesce(r.n, 0) * log2(coalesce(r.parts, 1)) + coalesce(f.n, 0) * (1 + log2(coalesce(f.slots, 1))), 3) AS bits FROM
(SELECT pair, greatest(count(DISTINCT c), 2) AS sigma FROM (SELECT pair, unnest({CHARS.format('form')}) AS c FROM (SELECT pair, form FROM l UNION ALL SELECT pair, form FROM a) WHERE form IS NOT NULL) GROUP BY 1) c
LEFT JOIN (SELECT pair, sum(length(form) + 1) AS x, count(form) AS n, greatest(count(DISTINCT pos), 1) AS parts FROM l GROUP BY 1) r USING (pair)
LEFT JOIN (SELECT pair, sum(length(form) + 1) AS x, count(form) AS n, greatest(count(DISTINCT slot_ord), 1) AS slots FROM a GROUP BY 1) f USING (pair)"""),
    "corpus_bits": with_(M, W, V, R, f"""al AS (SELECT pair, greatest(count(DISTINCT c), 2) AS sigma FROM (SELECT pair, unnest({CHARS.format('word')}) AS c FROM v) GROUP BY 1),
per AS (SELECT pair, word, coalesce(min(line) FILTER (accepted), min(line)) AS line, count(*) AS readings FROM r GROUP BY 1, 2),
mo AS (SELECT v.pair, v.n, unnest(string_split(line, '-')) AS morph FROM v JOIN per USING (pair, word)),
co AS (SELECT pair, morph, -log2(c / sum(c) OVER (PARTITION BY pair)) AS bits FROM (SELECT pair, morph, sum(n) AS c FROM mo GROUP BY 1, 2))""",
        body="""SELECT pair, round(rest + coalesce(x, 0), 3) AS bits FROM (SELECT v.pair, sum(CASE WHEN per.line IS NOT NULL THEN n * log2(readings) ELSE n * length(v.word) * log2(sigma) END) AS rest
FROM v LEFT JOIN per ON per.pair = v.pair AND per.word = v.word JOIN al ON al.pair = v.pair GROUP BY 1) LEFT JOIN (SELECT mo.pair, sum(n * bits) AS x FROM mo JOIN co USING (pair, morph) GROUP BY 1) USING (pair)"""),
    "worst_constructs": with_(M, R, GOLD, body="""SELECT pair, gloss, count(DISTINCT word) AS words, sum(hit) AS lost, sum(1 - hit) AS spared, (sum(1 - hit) - sum(hit))::DOUBLE AS worst FROM (
SELECT DISTINCT r.pair, r.word, r.line, CASE WHEN g.line IS NULL THEN 0 ELSE 1 END AS hit, unnest(string_split(r.line, '-')) AS gloss
FROM r JOIN (SELECT DISTINCT pair, word FROM gold) x ON x.pair = r.pair AND x.word = r.word LEFT JOIN gold g ON g.pair = r.pair AND g.word = r.word AND g.line = r.line) GROUP BY 1, 2"""),
    "ablated_root": with_(L, body="""SELECT pair, entry_id, form, "count" FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY "count" DESC, form, entry_id) - 1 AS p, count(*) OVER (PARTITION BY pair) AS c
FROM l WHERE form IS NOT NULL AND "count" IS NOT NULL) WHERE p = 3 % c"""),
    "affix_polarity": with_(A, body="""SELECT *, CASE WHEN prefixes > 1.3 * suffixes THEN 'prefixing' WHEN suffixes > 1.3 * prefixes THEN 'suffixing' ELSE 'both' END AS polarity FROM (
SELECT pair, count(*) FILTER (kind = 'prefix') AS prefixes, count(*) FILTER (kind = 'suffix') AS suffixes FROM a GROUP BY pair)"""),
    "reduplication": with_(M, W, V, body=f"""SELECT pair, count(*) FILTER (n >= 2) AS types, count(*) FILTER (hit) AS redup_types, round(count(*) FILTER (hit) / nullif(count(*) FILTER (n >= 2), 0), 6) AS type_rate,
round(coalesce(sum(n) FILTER (hit), 0) / sum(n), 6) AS token_rate FROM (SELECT *, n >= 2 AND len(list_filter([1, 2, 3], lambda k: left(word, k) = substr(word, k + 1, k) AND length(word) > 2 * k AND regexp_matches(left(word, k), '[{VOWELS}]'))) > 0 AS hit FROM v) GROUP BY pair"""),
    "infix_pairs": with_(M, W, V, body="""SELECT x.pair, infix, count(DISTINCT stem) AS stems FROM (SELECT pair, substr(word, 2, 2) AS infix, left(word, 1) || substr(word, 4) AS stem FROM v WHERE length(word) >= 5) x
JOIN v ON v.pair = x.pair AND v.word = stem GROUP BY 1, 2 HAVING count(DISTINCT stem) >= 2"""),
    "syllables": with_(M, W, V, body=f"""SELECT pair, count(*) AS words, round(avg(s), 6) AS mean, round(avg(CASE WHEN s = 1 THEN 1 ELSE 0 END), 6) AS monosyllables
FROM (SELECT pair, len(regexp_extract_all(lower(word), '[{VOWELS}]+')) AS s FROM v) GROUP BY pair"""),
    "unexplained_words": with_(M, W, V, L, body="""SELECT v.pair, sum(n) AS tokens, sum(CASE WHEN x.word IS NULL AND n >= 2 THEN n ELSE 0 END) AS unknown, round(sum(CASE WHEN x.word IS NULL AND n >= 2 THEN n ELSE 0 END) / sum(n), 6) AS share
FROM v LEFT JOIN (SELECT DISTINCT pair, lower(form) AS word FROM l) x ON x.pair = v.pair AND x.word = v.word GROUP BY 1"""),
    "homographs": with_(L, body="""SELECT pair, count(*) AS forms, count(*) FILTER (n > 1) AS homographs, round(count(*) FILTER (n > 1) / count(*), 6) AS share
FROM (SELECT pair, form, count(DISTINCT pos) AS n FROM l WHERE form IS NOT NULL GROUP BY 1, 2) GROUP BY pair"""),
    "feature_loci": with_(M, body="SELECT pair, type, kv.key AS name, count(*) AS n FROM (SELECT pair, type, unnest(map_entries(features)) AS kv FROM m WHERE type <> 'root') GROUP BY 1, 2, 3"),
}

QUERIES = {f.__name__: f for f in (
    edge_affixes, signature_affixes, longest_suffix, residues, open_residues, affix_families, stem_classes, near_affixes, near_roots, environments, affix_slots, parsed_words, parse_coverage, bpe_merges,
    reading_coverage, reading_ambiguity, reading_roundtrip, reading_overgeneration, reading_regression, boundary_scores, dead_affixes, tolerated_allomorphy, grammar_bits, corpus_bits,
    worst_constructs, ablated_root, affix_polarity, reduplication, infix_pairs, syllables, unexplained_words, homographs, feature_loci,
)}
