"""Queries over induction in rounds and over what it leaves unexplained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphloom.functions.text import VOWELS
from morphloom.operators import align, induce, morph
from morphloom.plans import relations as r
from morphloom.plans.corpus import C
from morphloom.plans.corpus import _candidate_table as candidates
from morphloom.plans.grammar import EDGE
from morphloom.plans.relations import A, L, M, V, W, with_
from morphloom.session import materialise


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("word"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.affixes(spark, folder).filter("form <> '' and kind in ('prefix', 'suffix')")
    return rows.select("pair", F.col("kind").alias("side"), F.lower("form").alias("affix"))


def peeled_words(spark: SparkSession, folder: str) -> DataFrame:
    return induce.peel(r.vocabulary(spark, folder), _known(spark, folder), _edges(spark, folder), ["pair"], 5)


def synthesis(spark: SparkSession, folder: str) -> DataFrame:
    words = r.vocabulary(spark, folder)
    found = induce.synthesis(words, induce.strip_edges(words, _edges(spark, folder), ["pair"]), ["pair"])
    return found.select("pair", F.round("index", 6).alias("index"), F.round("clean", 6).alias("clean"), "type")


def unexplained_mass(spark: SparkSession, folder: str) -> DataFrame:
    found = induce.unexplained(r.vocabulary(spark, folder), peeled_words(spark, folder), ["pair"])
    return found.select("pair", F.round("stacked", 6).alias("stacked"), F.round("exceptions", 6).alias("exceptions"))


def additive_words(spark: SparkSession, folder: str) -> DataFrame:
    return induce.additive_words(r.vocabulary(spark, folder), _known(spark, folder), _edges(spark, folder), ["pair"], 1)


def new_roots(spark: SparkSession, folder: str) -> DataFrame:
    return induce.grow_roots(r.vocabulary(spark, folder), _known(spark, folder).withColumnRenamed("word", "root"), _edges(spark, folder), ["pair"])


def guided_splits(spark: SparkSession, folder: str) -> DataFrame:
    counted = candidates(spark, folder).filter("prob >= 0.1")
    order = Window.partitionBy("space", "source").orderBy(F.desc("n"), "target")
    best = counted.withColumn("p", F.row_number().over(order)).filter("p = 1").select(F.col("space").alias("pair"), "source", "target")
    return induce.guided_splits(best, ["pair"], 3, 6, 2)


def family_debt(spark: SparkSession, folder: str) -> DataFrame:
    return induce.enumeration_debt(morph.harmony_families(r.affixes(spark, folder), ["pair"]), ["pair"])


def family_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return induce.archiphonemes(morph.harmony_families(r.affixes(spark, folder), ["pair"]), ["pair"])


def prefix_places(spark: SparkSession, folder: str) -> DataFrame:
    prefixes = _edges(spark, folder).filter("side = 'prefix'").select("pair", F.col("affix").alias("prefix"))
    return induce.place_histogram(r.vocabulary(spark, folder), prefixes, ["pair"])


def residue_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return induce.residue_patterns(r.vocabulary(spark, folder), _known(spark, folder), ["pair"])


def shared_cores(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.lexicon(spark, folder).filter("form is not null and pos <> ''")
    return induce.shared_core(rows.select("pair", "pos", F.lower("form").alias("word")), ["pair", "pos"], 4)


def word_examples(spark: SparkSession, folder: str) -> DataFrame:
    return induce.examples(r.verse_words(spark, folder), ["pair"], "verse", "word").filter("n >= 3")


def related_verses(spark: SparkSession, folder: str) -> DataFrame:
    focus = r.vocabulary(spark, folder).filter("n >= 4").select("pair", F.col("word").alias("focus"))
    return induce.related_rows(r.verse_words(spark, folder), focus, ["pair"], "verse")


def cotrained_roots(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).filter("form is not null").select("pair", F.lower("form").alias("form"), "gloss")
    fixes = r.affixes(spark, folder).filter("form <> ''").select("pair", F.lower("form").alias("form"), "gloss", "kind")
    name = lambda df: df.select(F.col("pair").alias("space"), F.col("verse").alias("row"), "at", "word")
    source, target = materialise(name(r.source_words(spark, folder)), "source"), materialise(name(r.verse_words(spark, folder)), "target")

    def table(parses: DataFrame) -> DataFrame:
        read = parses.filter("analysis = 1").select("space", "word", F.split("forms", "-").alias("parts"))
        parts = target.join(read, ["space", "word"], "left").select("space", "row", "at", F.posexplode(F.coalesce("parts", F.array("word"))).alias("i", "word"))
        morphs = parts.select("space", "row", F.struct("at", "i").alias("at"), "word")
        scores = align.dice_scores(source, morphs, "space", "row", "word")
        return align.best_glosses(align.gloss_table(align.dice_links(source, morphs, scores))).withColumnRenamed("space", "pair")

    return induce.cotrain(r.vocabulary(spark, folder), roots, fixes, table, ["pair"])[0]


AF = "af AS (SELECT DISTINCT pair, kind AS side, lower(form) AS affix FROM a WHERE form <> '' AND kind IN ('prefix', 'suffix'))"
KN = "kn AS (SELECT DISTINCT pair, lower(form) AS word FROM l WHERE form IS NOT NULL)"

STRIP = """iv AS (SELECT pair, list(affix ORDER BY length(affix) DESC, affix) FILTER (side = 'prefix') AS pre, list(affix ORDER BY length(affix) DESC, affix) FILTER (side = 'suffix') AS suf FROM (SELECT DISTINCT pair, side, affix FROM af) GROUP BY 1),
t0 AS (SELECT v.pair, v.word, v.word AS rest, 1 AS morphs, coalesce(pre, []) AS pre, coalesce(suf, []) AS suf FROM v LEFT JOIN iv USING (pair)),
t1 AS (SELECT * FROM t0 UNION ALL
  SELECT pair, word, CASE WHEN p IS NOT NULL THEN substr(rest, length(p) + 1) ELSE left(rest, length(rest) - length(s)) END, morphs + 1, pre, suf FROM (
    SELECT *, list_filter(pre, lambda x: starts_with(rest, x) AND length(rest) > length(x) + 1)[1] AS p, list_filter(suf, lambda x: ends_with(rest, x) AND length(rest) > length(x) + 1)[1] AS s FROM t1 WHERE length(rest) > 2)
  WHERE p IS NOT NULL OR s IS NOT NULL),
st AS (SELECT pair, word, arg_max(rest, morphs) AS rest, max(morphs) AS morphs FROM t1 GROUP BY 1, 2)"""

PEEL = """iv AS (SELECT pair, list(side || ':' || affix ORDER BY length(affix) DESC, side, affix) AS fix FROM (SELECT DISTINCT pair, side, affix FROM af WHERE length(affix) <= 6) GROUP BY 1),
ks AS (SELECT DISTINCT pair, word FROM kn),
q0 AS (SELECT v.pair, v.word, v.word AS stem, 0 AS peeled, coalesce(fix, []) AS fix, ks.word IS NOT NULL AS known FROM v LEFT JOIN iv ON iv.pair = v.pair LEFT JOIN ks ON ks.pair = v.pair AND ks.word = v.word),
q1 AS (SELECT * FROM q0 UNION ALL
  SELECT c.pair, c.word, c.rest, peeled + 1, fix, ks.word IS NOT NULL FROM (
    SELECT *, CASE WHEN starts_with(x, 'prefix:') THEN substr(stem, length(x) - 6) ELSE left(stem, length(stem) - length(x) + 7) END AS rest FROM (
      SELECT *, list_filter(fix, lambda f: CASE WHEN starts_with(f, 'prefix:') THEN starts_with(stem, substr(f, 8)) ELSE ends_with(stem, substr(f, 8)) END AND length(stem) >= length(f) - 7 + 2)[1] AS x FROM q1 WHERE NOT known AND peeled < 5)
    WHERE x IS NOT NULL) c LEFT JOIN ks ON ks.pair = c.pair AND ks.word = c.rest),
pl AS (SELECT pair, word, arg_max(stem, peeled) AS stem, max(peeled) AS peeled, arg_max(known, peeled) AS known FROM q1 GROUP BY 1, 2)"""
REDUP = f"len(list_filter([1, 2, 3], lambda k: left(v.word, k) = substr(v.word, k + 1, k) AND length(v.word) > 2 * k AND regexp_matches(left(v.word, k), '[{VOWELS}]'))) > 0"

SQL = {
    "peeled_words": "WITH RECURSIVE " + with_(M, W, V, L, A, KN, AF, PEEL, body="SELECT pair, word, stem, peeled, known FROM pl")[5:],
    "unexplained_mass": "WITH RECURSIVE " + with_(M, W, V, L, A, KN, AF, PEEL, body=f"""SELECT v.pair, round(sum(CASE WHEN known AND peeled >= 2 THEN n ELSE 0 END) / sum(n), 6) AS stacked,
round(sum(CASE WHEN NOT known AND NOT ({REDUP}) THEN n ELSE 0 END) / sum(n), 6) AS exceptions FROM v JOIN pl ON pl.pair = v.pair AND pl.word = v.word GROUP BY 1""")[5:],
    "family_patterns": with_(A, body="""SELECT pair, left(f, i - 1) || 'V' || substr(f, i + 1) AS pattern, array_to_string(list_sort(list_distinct(list_transform(m, lambda x: substr(x, i, 1)))), '') AS alternants FROM (
SELECT pair, m, f, d[1] AS i FROM (SELECT pair, m, m[1] AS f, list_filter(generate_series(1, length(m[1])), lambda i: len(list_distinct(list_transform(m, lambda x: substr(x, i, 1)))) > 1) AS d FROM (
SELECT pair, list_sort(list(DISTINCT form)) AS m FROM a WHERE form IS NOT NULL GROUP BY pair, translate(form, 'aeiouáéíóú', '') HAVING count(DISTINCT form) >= 2 AND count(DISTINCT length(form)) = 1)) WHERE len(d) = 1)
WHERE len(list_filter(m, lambda x: NOT contains('aeiou', substr(x, i, 1)))) = 0"""),
    "shared_cores": with_(L, body="""SELECT pair, pos, core, words FROM (SELECT *, row_number() OVER (PARTITION BY pair, pos ORDER BY words * length(core) DESC, length(core) DESC, core) AS k FROM (
SELECT pair, pos, core, count(DISTINCT word) AS words FROM (SELECT pair, pos, word, substr(word, i, n) AS core FROM (SELECT pair, pos, word, i, unnest(generate_series(4, length(word) - i + 1)) AS n FROM (
  SELECT pair, pos, word, unnest(generate_series(1, length(word) - 3)) AS i FROM (SELECT DISTINCT pair, pos, lower(form) AS word FROM l WHERE form IS NOT NULL AND pos <> '') WHERE length(word) >= 4)))
GROUP BY 1, 2, 3 HAVING count(DISTINCT word) >= 2)) WHERE k = 1"""),
    "synthesis": "WITH RECURSIVE " + with_(M, W, V, A, AF, STRIP, body=r"""SELECT i.pair, round(index, 6) AS index, round(clean, 6) AS clean,
CASE WHEN coalesce(c >= 50 AND m < 1.4 AND o > 0.7, false) OR index < 1.5 THEN 'isolating' WHEN index >= 3.5 THEN 'polysynthetic' WHEN index >= 2.3 THEN 'agglutinative' ELSE 'fusional' END AS type
FROM (SELECT st.pair, sum(v.n * morphs) / sum(v.n)::DOUBLE AS index, sum(CASE WHEN morphs >= 2 AND b.word IS NOT NULL THEN v.n ELSE 0 END) / sum(v.n)::DOUBLE AS clean
  FROM st JOIN v ON v.pair = st.pair AND v.word = st.word LEFT JOIN v b ON b.pair = st.pair AND b.word = st.rest AND b.n >= 2 AND length(b.word) >= 2 WHERE regexp_full_match(st.word, '\p{L}{2,}') GROUP BY 1) i
LEFT JOIN (SELECT pair, count(*) AS c, avg(g) AS m, avg(CASE WHEN g = 1 THEN 1.0 ELSE 0 END) AS o FROM (
  SELECT pair, len(regexp_extract_all(word, '[' || 'VOWELS' || ']+')) AS g FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, word) AS k FROM v WHERE regexp_full_match(word, '\p{L}{2,}')) WHERE k <= 400) WHERE g > 0 GROUP BY 1) s ON s.pair = i.pair""".replace("VOWELS", VOWELS).replace("\\\\", "\\"))[5:],
    "additive_words": with_(M, W, V, L, A, AF, KN, EDGE, body="""SELECT DISTINCT v.pair, v.word, v.n FROM v JOIN e ON e.pair = v.pair AND e.word = v.word AND e.k <= 6 AND length(e.stem) >= 2 JOIN af ON af.pair = e.pair AND af.side = e.side AND af.affix = e.affix
LEFT JOIN (SELECT pair, affix AS sfx FROM af WHERE side = 'suffix') z ON z.pair = e.pair AND e.side = 'prefix' AND ends_with(e.stem, z.sfx) AND length(e.stem) - length(z.sfx) >= 2 AND length(z.sfx) <= 6
WHERE (v.pair, v.word) NOT IN (SELECT pair, word FROM kn) AND ((v.pair, e.stem) IN (SELECT pair, word FROM kn) OR (z.sfx IS NOT NULL AND (v.pair, left(e.stem, length(e.stem) - length(z.sfx))) IN (SELECT pair, word FROM kn)))"""),
    "new_roots": with_(M, W, V, L, A, AF, KN, EDGE, body="""SELECT pair, root, n FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, root) AS p FROM (SELECT pair, stem AS root, sum(n) AS n FROM (
SELECT e.pair, e.word, e.n, e.stem, row_number() OVER (PARTITION BY e.pair, e.word ORDER BY length(e.affix) DESC, e.side, e.affix) AS k FROM e JOIN af ON af.pair = e.pair AND af.side = e.side AND af.affix = e.affix WHERE e.k <= 6 AND length(e.stem) >= 3)
WHERE k = 1 AND (pair, stem) NOT IN (SELECT pair, word FROM kn) GROUP BY 1, 2)) WHERE p <= 20"""),
    "guided_splits": with_(C, """b AS (SELECT pair, source, target FROM (SELECT *, row_number() OVER (PARTITION BY pair, source ORDER BY n DESC, target) AS p FROM g WHERE prob >= 0.1) WHERE p = 1)""", body="""
SELECT pair, word, base, residue FROM (SELECT *, count(*) OVER (PARTITION BY pair, residue) AS c FROM (SELECT x.*, row_number() OVER (PARTITION BY x.pair, word ORDER BY length(base)) AS p FROM (
SELECT pair, source AS word, target, left(source, k) AS base, substr(source, k + 1) AS residue FROM (SELECT *, unnest(range(3, length(source))) AS k FROM b WHERE length(source) > 3) WHERE length(source) - k <= 6) x
JOIN b ON b.pair = x.pair AND b.source = x.base AND b.target <> x.target) WHERE p = 1) WHERE c >= 2"""),
    "family_debt": with_(A, body="""SELECT pair, count(*) AS families, sum(c - 1) AS debt FROM (SELECT pair, translate(form, 'aeiouáéíóú', '') AS s, count(DISTINCT form) AS c FROM a WHERE form IS NOT NULL GROUP BY 1, 2) WHERE c >= 2 GROUP BY 1"""),
    "prefix_places": with_(M, W, V, A, AF, EDGE, body="""SELECT pair, prefix, place, sum(n) AS n FROM (SELECT e.pair, e.affix AS prefix, e.n, CASE WHEN contains('pbmfvw', left(stem, 1)) THEN 'labial' WHEN contains('tdnszlrj', left(stem, 1)) THEN 'coronal' WHEN contains('kgxŋqh', left(stem, 1)) THEN 'dorsal' END AS place
FROM e JOIN af ON af.pair = e.pair AND af.side = 'prefix' AND af.affix = e.affix WHERE e.side = 'prefix' AND e.k <= 4 AND length(stem) >= 2) WHERE place IS NOT NULL GROUP BY 1, 2, 3"""),
    "residue_patterns": with_(M, W, V, L, KN, body="""SELECT pair, side, edge, words FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY words DESC, side, edge) AS p FROM (SELECT pair, side, edge, count(*) AS words FROM (
SELECT pair, 'prefix' AS side, left(word, 2) AS edge FROM x UNION ALL SELECT pair, 'suffix', right(word, 2) FROM x) GROUP BY 1, 2, 3 HAVING count(*) >= 4)) WHERE p <= 6""").replace("\nSELECT pair, side, edge, words", ",\nx AS (SELECT pair, word FROM v WHERE length(word) > 3 AND (pair, word) NOT IN (SELECT pair, word FROM kn))\nSELECT pair, side, edge, words", 1),
    "word_examples": with_(M, W, body="""SELECT pair, word, sum(c) AS n, string_agg(verse, ' | ' ORDER BY verse) FILTER (p <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY pair, word ORDER BY verse) AS p FROM (
SELECT pair, word, verse, count(*) AS c FROM w GROUP BY 1, 2, 3)) GROUP BY 1, 2 HAVING sum(c) >= 3"""),
    "related_verses": with_(M, W, V, body="""SELECT pair, focus, verse, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY pair, focus ORDER BY weight DESC, verse) AS place FROM (
SELECT d.pair, f.word AS focus, d.verse, sum(v.n) AS weight FROM (SELECT DISTINCT pair, verse, word FROM w WHERE length(word) >= 4) d JOIN v ON v.pair = d.pair AND v.word = d.word
JOIN (SELECT pair, word FROM v WHERE n >= 4 AND length(word) >= 4) f ON f.pair = d.pair AND left(f.word, 4) = left(d.word, 4) GROUP BY 1, 2, 3)) WHERE place <= 5"""),
}

QUERIES = {f.__name__: f for f in (
    peeled_words, synthesis, unexplained_mass, additive_words, new_roots, guided_splits, family_debt, family_patterns, prefix_places, residue_patterns, shared_cores, word_examples, related_verses, cotrained_roots,
)}
