"""DuckDB's SQL for the llm queries that SQL can express."""

from __future__ import annotations

SQL = {
    "p2_found": """
WITH m AS (
  SELECT * FROM (SELECT marker_id, pair, verse, form, row_number() OVER (PARTITION BY marker_id ORDER BY loaded_at DESC) AS k FROM morph_markers)
  WHERE k = 1 AND form IS NOT NULL),
mt AS (SELECT form, count(DISTINCT row(pair, verse)) AS n FROM m GROUP BY form),
mn AS (SELECT count(DISTINCT row(pair, verse)) AS total FROM m),
l AS (
  SELECT * FROM (SELECT entry_id, form, "count" AS c, row_number() OVER (PARTITION BY entry_id ORDER BY updated_at DESC) AS k FROM lex_entries)
  WHERE k = 1 AND c >= 0 AND form IS NOT NULL),
lt AS (SELECT form, sum(c) AS n FROM l GROUP BY form),
ln AS (SELECT sum(c) AS total FROM l),
a AS (
  SELECT * FROM (SELECT affix_id, form, "count" AS c, row_number() OVER (PARTITION BY affix_id ORDER BY updated_at DESC) AS k FROM affixes)
  WHERE k = 1 AND c >= 0 AND form IS NOT NULL),
af AS (SELECT form, sum(c) AS n FROM a GROUP BY form),
an AS (SELECT sum(c) AS total FROM a)
SELECT 'morph_markers' AS tab, form AS term, 'rare' AS mark FROM mt WHERE n < 3
UNION ALL SELECT 'morph_markers', form, 'common' FROM mt, mn WHERE n > 0.02 * total
UNION ALL SELECT 'lex_entries', form, 'rare' FROM lt WHERE n < 3
UNION ALL SELECT 'lex_entries', form, 'common' FROM lt, ln WHERE n > 0.01 * total
UNION ALL SELECT 'affixes', form, 'rare' FROM af WHERE n < 3
UNION ALL SELECT 'affixes', form, 'common' FROM af, an WHERE n > 0.01 * total
""",
    "p3_found": """
WITH live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) AS k FROM gloss_candidates) WHERE k = 1)
SELECT pair, target_word, place, cand_id FROM (
  SELECT pair, target_word, cand_id, row_number() OVER (
    PARTITION BY pair, target_word ORDER BY prob DESC, "count" DESC NULLS LAST, source_word, cand_id) AS place
  FROM live WHERE target_word IS NOT NULL AND source_word IS NOT NULL AND NOT isnan(prob) AND prob >= 0 AND prob <= 1)
WHERE place <= 3
""",
    "p5_found": """
WITH live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) AS k FROM gloss_candidates) WHERE k = 1),
b AS (SELECT DISTINCT pair, chunk_id, target_word, source_word AS w FROM live
      WHERE target_word IS NOT NULL AND source_word IS NOT NULL AND "count" >= 2),
total AS (SELECT pair, count(*) AS n FROM (SELECT DISTINCT pair, chunk_id, target_word FROM b) GROUP BY pair),
one AS (SELECT pair, w, count(*) AS n FROM b GROUP BY pair, w),
two AS (SELECT x.pair, x.w AS word_a, y.w AS word_b, count(*) AS n
        FROM b x JOIN b y ON x.pair = y.pair AND x.chunk_id = y.chunk_id AND x.target_word = y.target_word AND x.w < y.w
        GROUP BY x.pair, x.w, y.w HAVING count(*) >= 5)
SELECT two.pair, two.word_a, two.word_b FROM two
JOIN one a ON a.pair = two.pair AND a.w = word_a JOIN one c ON c.pair = two.pair AND c.w = word_b JOIN total ON total.pair = two.pair
WHERE two.n * total.n >= 8 * a.n * c.n
""",
}
