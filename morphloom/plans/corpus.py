"""Queries over words, texts and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphloom.functions import text as fx
from morphloom.operators import align, sequence, stats
from morphloom.plans import relations as r
from morphloom.plans.relations import M, S, V, W, L, with_
from morphloom.plans.tables import table


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return r.vocabulary(spark, folder)


def doc_vocab(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("lang", F.explode(fx.tokens(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def token_classes(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("lang", F.explode(F.split("text", " ")).alias("t")).filter(F.col("t") != "")
    return words.groupBy("lang", fx.token_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def type_token(spark: SparkSession, folder: str) -> DataFrame:
    once = F.sum((F.col("n") == 1).cast("int"))
    per = r.vocabulary(spark, folder).groupBy("pair").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), once.alias("hapax"))
    return per.withColumn("hapax_share", F.round(F.col("hapax") / F.col("types"), 6))


def top_coverage(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("n"), "word"))
    ranked = r.vocabulary(spark, folder).withColumn("place", place)
    top = lambda k: F.round(F.sum(F.when(F.col("place") <= k, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return ranked.groupBy("pair").agg(top(500).alias("top_500"), top(2000).alias("top_2000"))


def word_shapes(spark: SparkSession, folder: str) -> DataFrame:
    word = F.col("word")
    flags = [F.sum(f.cast("int")).cast("bigint").alias(n) for n, f in (("alpha", fx.is_alpha(word)), ("word_mark", fx.is_word_mark(word)), ("joined", fx.is_word(word)))]
    return r.vocabulary(spark, folder).groupBy("pair").agg(*flags)


def _dice(spark: SparkSession, folder: str) -> DataFrame:
    return align.dice_scores(r.source_words(spark, folder), r.verse_words(spark, folder), "pair", "verse", "word")


def dice_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _dice(spark, folder).filter("n_both >= 2").select(F.col("space").alias("pair"), "target", "source", "n_both", F.round("dice", 6).alias("dice"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    name = lambda df: df.select(F.col("pair").alias("space"), F.col("verse").alias("row"), "at", "word")
    return align.dice_links(name(r.source_words(spark, folder)), name(r.verse_words(spark, folder)), _dice(spark, folder))


def gloss_links(spark: SparkSession, folder: str) -> DataFrame:
    return align.gloss_table(_links(spark, folder)).select(F.col("space").alias("pair"), "target", "source", "n", "prob", "rank")


def em_gloss(spark: SparkSession, folder: str) -> DataFrame:
    name = lambda df: df.select(F.col("pair").alias("space"), F.col("verse").alias("row"), "at", "word")
    return align.em_table(name(r.source_words(spark, folder)), name(r.verse_words(spark, folder)), 5)


def _candidate_table(spark: SparkSession, folder: str) -> DataFrame:
    live = r.live_rows(table(spark, folder, "gloss_candidates").select("cand_id", "loaded_at", "pair", "target_word", "source_word", "count"), "cand_id", "loaded_at")
    good = live.filter(F.col("target_word").isNotNull() & F.col("source_word").isNotNull() & (F.col("count") > 0))
    return align.rank_glosses(good.groupBy(F.col("pair").alias("space"), F.col("target_word").alias("target"), F.col("source_word").alias("source")).agg(F.sum("count").alias("n")))


def gloss_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _candidate_table(spark, folder).filter("rank <= 5").select(F.col("space").alias("pair"), "target", "source", "n", "prob", "rank")


def sense_link_ops(spark: SparkSession, folder: str) -> DataFrame:
    return align.sense_links(_candidate_table(spark, folder)).withColumnRenamed("space", "pair")


def gloss_tiers(spark: SparkSession, folder: str) -> DataFrame:
    best = align.best_glosses(_candidate_table(spark, folder))
    return best.groupBy(F.col("space").alias("pair"), align.confidence_tier(F.col("prob"), F.col("n")).alias("tier")).agg(F.count(F.lit(1)).alias("targets"))


def stem_groups(spark: SparkSession, folder: str) -> DataFrame:
    return r.vocabulary(spark, folder).groupBy("pair", align.stem_group(F.col("word")).alias("stem")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


def form_pos(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "form", "pos").filter("form is not null and pos <> ''")
    return stats.modal(rows, ["pair", "form"], "pos", support=2, share=0.6).select("pair", "form", "pos", "n", F.round("share", 6).alias("share"))


def pos_entropy(spark: SparkSession, folder: str) -> DataFrame:
    counts = r.markers(spark, folder, "pair", "pos").filter("pos <> ''").groupBy("pair", "pos").agg(F.count(F.lit(1)).alias("n"))
    return stats.entropy(counts, ["pair"], "n").select("pair", F.round("entropy", 6).alias("entropy"))


def decision_gain(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "type", "decision").filter("type is not null and decision is not null")
    counts = rows.groupBy("pair", "type", "decision").agg(F.count(F.lit(1)).alias("n"))
    return stats.information_gain(counts, ["pair"], "decision", "type", "n").select("pair", F.round("gain", 6).alias("gain"))


def affix_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "form", "type", "features").filter("form is not null and type <> 'root'")
    each = rows.select("marker_id", F.concat_ws(":", "pair", "type", "form").alias("affix"), F.explode_outer("features").alias("k", "v"))
    named = each.select("marker_id", "affix", F.when(F.col("k").isNotNull(), F.concat_ws("=", "k", "v")).alias("feature"))
    return stats.lift(named, "affix", "feature", named).select("affix", "feature", "n", "n_item", F.round("share", 6).alias("share"), F.round("lift", 4).alias("lift"))


def pair_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.set_overlap(r.lexicon(spark, folder).filter("form is not null"), "pair", "form", 1)
    return found.select(F.col("left").alias("pair_a"), F.col("right").alias("pair_b"), "shared", F.round("jaccard", 6).alias("jaccard"))


def freq_spearman(spark: SparkSession, folder: str) -> DataFrame:
    lex = r.lexicon(spark, folder).filter("count >= 0").groupBy("pair", "form").agg(F.sum("count").alias("c"))
    seen = r.markers(spark, folder, "pair", "form").filter("form is not null").groupBy("pair", "form").agg(F.count(F.lit(1)).alias("n"))
    return stats.spearman(lex.join(seen, ["pair", "form"]), ["pair"], "c", "n").select("pair", "n", F.round("rho", 6).alias("rho"))


def char_association(spark: SparkSession, folder: str) -> DataFrame:
    chars = r.vocabulary(spark, folder).select("pair", "word", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), 0)).alias("at", "c"))
    found = stats.adjacent_association(chars, ["pair"], "word", "at", "c", 20)
    return found.select("pair", "first", "second", "n", F.round("association", 4).alias("association")).filter("association > 3")


def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(stats.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


def morph_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "type").withColumn("at", F.shiftleft(F.col("word_idx").cast("bigint"), 32) + F.col("morph_idx"))
    one = rows.groupBy("pair", "verse", "at").agg(F.min("type").alias("type"))
    found = sequence.neighbours(one, ["pair", "verse"], "at", "type")
    return found.filter("after is not null and type is not null").groupBy("pair", "type", F.col("after").alias("next_type")).agg(F.count(F.lit(1)).alias("n"))


def word_contexts(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.context(r.verse_words(spark, folder), ["pair", "verse"], "at", "word")
    key = F.concat(F.array_join("left", " "), F.lit(" _ "), F.array_join("right", " "))
    return rows.groupBy("pair", "word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("contexts")).filter("n >= 3")


def first_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.neighbours(r.verse_words(spark, folder), ["pair", "verse"], "at", "word")
    return rows.filter(F.col("before") == fx.START).groupBy("pair", "word").agg(F.count(F.lit(1)).alias("n"))


def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("begin"))
    one = rows.groupBy("user_id", "begin").agg(F.min("event_id").alias("event_id"))
    gaps = sequence.boundary_gaps(one.withColumn("finish", F.col("begin") + 1.0), ["user_id"], "begin", "finish", 3600.0)
    return gaps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap"), 3).alias("gap"))


def type_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.markers(spark, folder, "pair", "verse", "word_idx", "morph_idx", "type")
    return sequence.role_order(rows, ["pair", "verse", "word_idx"], "morph_idx", "type", ["prefix", "root", "suffix"])


C = """c AS (
  SELECT pair, target_word AS target, source_word AS source, sum("count") AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) AS k FROM gloss_candidates)
  WHERE k = 1 AND target_word IS NOT NULL AND source_word IS NOT NULL AND "count" > 0 GROUP BY 1, 2, 3),
g AS (SELECT pair, target, source, n, round(n / sum(n) OVER (PARTITION BY pair, target), 4) AS prob,
  row_number() OVER (PARTITION BY pair, target ORDER BY n DESC, source) AS rank FROM c)"""
DICE = """ds AS (SELECT DISTINCT pair, verse, word FROM s), dt AS (SELECT DISTINCT pair, verse, word FROM w),
ns AS (SELECT pair, word, count(*) AS n FROM ds GROUP BY 1, 2), nt AS (SELECT pair, word, count(*) AS n FROM dt GROUP BY 1, 2),
nb AS (SELECT ds.pair, dt.word AS target, ds.word AS source, count(*) AS n FROM ds JOIN dt ON ds.pair = dt.pair AND ds.verse = dt.verse GROUP BY 1, 2, 3),
d AS (SELECT nb.pair, target, source, nb.n AS n_both, 2.0::DOUBLE * nb.n / (ns.n + nt.n) AS dice FROM nb
  JOIN ns ON ns.pair = nb.pair AND ns.word = source JOIN nt ON nt.pair = nb.pair AND nt.word = target)"""
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]*"

SQL = {
    "token_classes": r"""SELECT lang, CASE WHEN regexp_full_match(t, '\p{L}+(?:[-''’]\p{L}+)*') THEN 'word' WHEN regexp_full_match(replace(replace(b, ',', ''), '.', ''), '\p{N}+') AND length(b) - length(replace(b, '.', '')) <= 1 THEN 'number'
WHEN regexp_full_match(t, '[\p{P}\p{S}]+') THEN 'punctuation' ELSE 'other' END AS class, count(*) AS n
FROM (SELECT lang, t, regexp_replace(t, '\A[^\p{N}]+|[^\p{N}]+\z', '', 'g') AS b FROM (SELECT lang, unnest(string_split(text, ' ')) AS t FROM documents) WHERE t <> '') GROUP BY 1, 2""",
    "char_association": with_(M, W, V, body="""SELECT pair, first, second, n, round(association, 4) AS association FROM (
SELECT b.pair, b.first, b.second, b.n, (b.n / t.total) / ((x.n / t.total) * (y.n / t.total) + 1e-9) AS association
FROM (SELECT pair, substr(word, i, 1) AS first, substr(word, i + 1, 1) AS second, count(*) AS n FROM (SELECT pair, word, unnest(generate_series(1, length(word) - 1)) AS i FROM v) GROUP BY 1, 2, 3 HAVING count(*) >= 20) b
JOIN (SELECT pair, substr(word, i, 1) AS c, count(*) AS n FROM (SELECT pair, word, unnest(generate_series(1, length(word))) AS i FROM v) GROUP BY 1, 2) x ON x.pair = b.pair AND x.c = b.first
JOIN (SELECT pair, substr(word, i, 1) AS c, count(*) AS n FROM (SELECT pair, word, unnest(generate_series(1, length(word))) AS i FROM v) GROUP BY 1, 2) y ON y.pair = b.pair AND y.c = b.second
JOIN (SELECT pair, sum(length(word)) AS total FROM v GROUP BY 1) t ON t.pair = b.pair) WHERE association > 3"""),
    "vocab": with_(M, W, V, body="SELECT pair, word, n FROM v"),
    "doc_vocab": f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents) GROUP BY 1, 2",
    "type_token": with_(M, W, V, body="SELECT pair, count(*) AS types, sum(n) AS tokens, count(*) FILTER (n = 1) AS hapax, round(count(*) FILTER (n = 1) / count(*), 6) AS hapax_share FROM v GROUP BY pair"),
    "top_coverage": with_(M, W, V, body="""SELECT pair, round(sum(n) FILTER (place <= 500) / sum(n), 6) AS top_500, round(sum(n) FILTER (place <= 2000) / sum(n), 6) AS top_2000
FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, word) AS place FROM v) GROUP BY pair"""),
    "word_shapes": with_(M, W, V, body=r"""SELECT pair, count(*) FILTER (regexp_full_match(word, '\p{L}+')) AS alpha, count(*) FILTER (regexp_full_match(word, '[\p{L}\p{M}]+')) AS word_mark,
count(*) FILTER (regexp_full_match(word, '\p{L}+(?:[-''’]\p{L}+)*')) AS joined FROM v GROUP BY pair"""),
    "dice_pairs": with_(M, W, S, DICE, body="SELECT pair, target, source, n_both, round(dice, 6) AS dice FROM d WHERE n_both >= 2"),
    "gloss_links": with_(M, W, S, DICE, body="""SELECT pair, target, source, n, round(n / sum(n) OVER (PARTITION BY pair, target), 4) AS prob, row_number() OVER (PARTITION BY pair, target ORDER BY n DESC, source) AS rank FROM (
SELECT w.pair, w.word AS target, b.source, count(*) AS n FROM w JOIN (
  SELECT * FROM (SELECT x.pair, x.verse, x.target, x.source, row_number() OVER (PARTITION BY x.pair, x.verse, x.target ORDER BY d.dice DESC, x.at_, x.source) AS k FROM (
    SELECT dt.pair, dt.verse, dt.word AS target, f.word AS source, f.at_ FROM dt JOIN (SELECT pair, verse, word, min(at_) AS at_ FROM s GROUP BY 1, 2, 3) f ON f.pair = dt.pair AND f.verse = dt.verse) x
    JOIN d ON d.pair = x.pair AND d.target = x.target AND d.source = x.source) WHERE k = 1) b ON b.pair = w.pair AND b.verse = w.verse AND b.target = w.word GROUP BY 1, 2, 3)"""),
    "gloss_ranked": with_(C, body="SELECT pair, target, source, n, prob, rank FROM g WHERE rank <= 5"),
    "sense_link_ops": with_(C, body="SELECT 'bilingual.sense_link.add' AS op, pair, source AS reference_lemma, target AS vernacular_sense, round(least(prob, 0.6), 4) AS confidence FROM g WHERE rank = 1 AND prob >= 0.5 AND n >= 2"),
    "gloss_tiers": with_(C, body="SELECT pair, CASE WHEN prob >= 0.5 AND n >= 2 THEN 'high' WHEN prob >= 0.25 THEN 'medium' ELSE 'low' END AS tier, count(*) AS targets FROM g WHERE rank = 1 GROUP BY 1, 2"),
    "stem_groups": with_(M, W, V, body="SELECT pair, CASE WHEN length(word) >= 5 THEN left(word, 5) ELSE word END AS stem, count(*) AS words, sum(n) AS n FROM v GROUP BY 1, 2"),
    "form_pos": with_(M, body="""SELECT pair, form, pos, n, round(n / total, 6) AS share FROM (
SELECT *, sum(n) OVER (PARTITION BY pair, form) AS total, row_number() OVER (PARTITION BY pair, form ORDER BY n DESC, pos) AS p FROM (
SELECT pair, form, pos, count(*) AS n FROM m WHERE form IS NOT NULL AND pos <> '' GROUP BY 1, 2, 3)) WHERE p = 1 AND n >= 2 AND n / total >= 0.6"""),
    "pos_entropy": with_(M, body="""SELECT pair, round(-sum(p * log2(p)), 6) AS entropy FROM (
SELECT pair, n / sum(n) OVER (PARTITION BY pair) AS p FROM (SELECT pair, pos, count(*) AS n FROM m WHERE pos <> '' GROUP BY 1, 2)) GROUP BY pair"""),
    "decision_gain": with_(M, body="""SELECT pair, round(h - i, 6) AS gain FROM (
SELECT pair, -sum(p * log2(p)) AS h FROM (SELECT pair, n / sum(n) OVER (PARTITION BY pair) AS p FROM (SELECT pair, decision, count(*) AS n FROM m WHERE type IS NOT NULL AND decision IS NOT NULL GROUP BY 1, 2)) GROUP BY pair)
JOIN (SELECT pair, sum(h * s) / sum(s) AS i FROM (SELECT pair, type, -sum(p * log2(p)) AS h, sum(n) AS s FROM (
SELECT pair, type, n, n / sum(n) OVER (PARTITION BY pair, type) AS p FROM (SELECT pair, type, decision, count(*) AS n FROM m WHERE type IS NOT NULL AND decision IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY pair) USING (pair)"""),
    "affix_functions": with_(M, body="""SELECT affix, feature, n, n_item, round(share, 6) AS share, round(lift, 4) AS lift FROM (
SELECT *, row_number() OVER (PARTITION BY affix ORDER BY round(lift, 2) DESC, n DESC, feature) AS k FROM (
SELECT p.affix, p.feature, p.n, i.n AS n_item, p.n / i.n AS share, (p.n / i.n) / (b.n / t.n) AS lift FROM
(SELECT affix, feature, count(*) AS n FROM e WHERE feature IS NOT NULL GROUP BY 1, 2) p JOIN (SELECT affix, count(*) AS n FROM e GROUP BY 1) i USING (affix)
JOIN (SELECT feature, count(*) AS n FROM e WHERE feature IS NOT NULL GROUP BY 1) b USING (feature), (SELECT count(feature) AS n FROM e) t)
WHERE n >= 6 AND share >= 0.3 AND lift >= 1.6) WHERE k = 1""").replace("\nSELECT affix, feature, n, n_item", """,
e AS (SELECT affix, k || '=' || v AS feature FROM (
  SELECT pair || ':' || type || ':' || form AS affix, kv.key AS k, kv.value AS v FROM (
    SELECT *, unnest(CASE WHEN features IS NULL OR cardinality(features) = 0 THEN [NULL] ELSE map_entries(features) END) AS kv FROM m WHERE form IS NOT NULL AND type <> 'root')))
SELECT affix, feature, n, n_item""", 1),
    "pair_overlap": with_(L, body="""SELECT x.pair AS pair_a, y.pair AS pair_b, count(*) AS shared, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard
FROM (SELECT DISTINCT pair, form FROM l) x JOIN (SELECT DISTINCT pair, form FROM l) y ON x.form = y.form AND x.pair < y.pair
JOIN (SELECT pair, count(DISTINCT form) AS n FROM l GROUP BY 1) a ON a.pair = x.pair JOIN (SELECT pair, count(DISTINCT form) AS n FROM l GROUP BY 1) b ON b.pair = y.pair GROUP BY 1, 2"""),
    "freq_spearman": with_(M, L, body="""SELECT pair, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
SELECT pair, rank() OVER (PARTITION BY pair ORDER BY c) + (count(*) OVER (PARTITION BY pair, c) - 1) / 2 AS rx, rank() OVER (PARTITION BY pair ORDER BY n) + (count(*) OVER (PARTITION BY pair, n) - 1) / 2 AS ry FROM (
SELECT pair, form, sum("count") AS c FROM l WHERE "count" >= 0 GROUP BY 1, 2) JOIN (SELECT pair, form, count(*) AS n FROM m WHERE form IS NOT NULL GROUP BY 1, 2) USING (pair, form)) GROUP BY pair"""),
    "vector_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "morph_bigrams": with_(M, body="""SELECT pair, type, next_type, count(*) AS n FROM (SELECT pair, type, lead(type) OVER (PARTITION BY pair, verse ORDER BY at_) AS next_type FROM (
SELECT pair, verse, word_idx::BIGINT * 4294967296 + morph_idx AS at_, min(type) AS type FROM m GROUP BY 1, 2, 3)) WHERE type IS NOT NULL AND next_type IS NOT NULL GROUP BY 1, 2, 3"""),
    "word_contexts": with_(M, W, body="""SELECT pair, word, count(*) AS n, count(DISTINCT c) AS contexts FROM (SELECT pair, word,
array_to_string(list(word) OVER (PARTITION BY pair, verse ORDER BY at_ ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' ') AS x, 
coalesce(array_to_string(list(word) OVER (PARTITION BY pair, verse ORDER BY at_ ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' '), '') || ' _ ' ||
coalesce(array_to_string(list(word) OVER (PARTITION BY pair, verse ORDER BY at_ ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' '), '') AS c FROM w) GROUP BY 1, 2 HAVING count(*) >= 3"""),
    "first_words": with_(M, W, body="SELECT pair, word, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pair, verse ORDER BY at_) AS k FROM w) WHERE k = 1 GROUP BY 1, 2"),
    "event_gaps": """SELECT user_id, count(*) AS n, round(sum(gap), 3) AS gap FROM (SELECT user_id, least(
coalesce(greatest(begin - lag(begin + 1.0) OVER o, 0.0), 0.0) + coalesce(greatest(lead(begin) OVER o - (begin + 1.0), 0.0), 0.0), 3600.0) AS gap
FROM (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS begin FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY begin)) GROUP BY user_id""",
    "type_orders": with_(M, body="""SELECT pattern, count(*) AS n FROM (SELECT pair, verse, word_idx, string_agg(type, '' ORDER BY at_, type) AS pattern FROM (
SELECT pair, verse, word_idx, type, min(morph_idx) AS at_ FROM m WHERE type IN ('prefix', 'root', 'suffix') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY pattern"""),
}

QUERIES = {f.__name__: f for f in (
    vocab, doc_vocab, token_classes, type_token, top_coverage, word_shapes, dice_pairs, gloss_links, em_gloss, gloss_ranked, sense_link_ops, gloss_tiers, stem_groups,
    form_pos, pos_entropy, decision_gain, affix_functions, pair_overlap, freq_spearman, char_association, vector_cosine, morph_bigrams, word_contexts, first_words, event_gaps, type_orders,
)}
