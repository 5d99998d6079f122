"""Queries over proposals, tickets and the ledger, and the ledger as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.operators import detect, gates, ledger, review, switches
from morphloom.operators.live import live_rows
from morphloom.plans import grammar
from morphloom.plans import relations as r
from morphloom.plans.relations import A, L, M, V, W, with_
from morphloom.plans.tables import table
from morphloom.session import materialise
from morphloom.streaming import ledger as stream


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    return live_rows(table(spark, folder, "gemma_proposals"), "prop_id", "proposed_at")


def _sure() -> Column:
    return F.when(F.col("conf") == "high", 0.9).when(F.col("conf") == "medium", 0.6).when(F.col("conf") == "low", 0.3)


def _ops(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proposals(spark, folder).filter("word is not null")
    key = ledger.entry_name(F.col("pair"), F.col("word"))
    return rows.select(F.lit("lexical.sense.create").alias("op"), key.alias("key"), _sure().alias("confidence"), F.col("aligner_top1").alias("source"), (F.col("prop_id") * 2).alias("ordinal"), "gloss", "pos")


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proposals(spark, folder).filter("word is not null and decision = 'accept'")
    key = ledger.entry_name(F.col("pair"), F.col("word"))
    return rows.select(F.lit("lexical.sense.create").alias("op"), key.alias("key"), "decision", F.lit("human").alias("by"), (F.col("prop_id") * 2 + 1).alias("ordinal"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    ops = _ops(spark, folder).filter("gloss <> ''")
    return ledger.route(ledger.merge_changes(ops, "ordinal", ["gloss", "pos"], decisions=_decisions(spark, folder)))


def auto_accept(spark: SparkSession, folder: str) -> DataFrame:
    gated = review.gate(_proposals(spark, folder), "conf", "aligner_top1", "gloss")
    return gated.groupBy("pair", "conf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("accepted").cast("int")).alias("accepted"))


def accept_precision(spark: SparkSession, folder: str) -> DataFrame:
    gated = review.gate(_proposals(spark, folder), "conf", "aligner_top1", "gloss").withColumn("truth", F.col("decision") == "accept")
    return review.precision(gated, ["pair"], "accepted", "truth").select("pair", "accepted", "right", F.round("precision", 6).alias("precision"))


def ledger_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = ledger.merge_changes(_ops(spark, folder), "ordinal", ["gloss", "pos"])
    return merged.select("op", "key", "confidence", "rounds_seen", "status", F.array_join("provenance", "|").alias("provenance"), "gloss", "pos")


def ledger_decide(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).select("op", "key", "confidence", "rounds_seen", "status", "locked", "decided_by", "gloss")


def ledger_route(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.route_tally(_ledger(spark, folder))


def ledger_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of the even proposals, and then the odd ones merged into it."""
    ops, decisions = _ops(spark, folder).filter("gloss <> ''"), _decisions(spark, folder)
    part = lambda df, rest: df.filter((F.shiftright("ordinal", 1) % 2) == rest)
    first = ledger.merge_changes(part(ops, 0), "ordinal", ["gloss", "pos"], decisions=part(decisions, 0))
    both = ledger.route(ledger.merge_changes(part(ops, 1), "ordinal", ["gloss", "pos"], state=materialise(first, "ledger"), decisions=part(decisions, 1)))
    return both.select("op", "key", "confidence", "rounds_seen", "status", "locked", "gloss")


def ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.summary(_ledger(spark, folder))


def ledger_accepted(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.create_map(F.lit("entry"), F.col("key"), F.lit("gloss"), F.col("gloss"))
    return ledger.accepted_changes(_ledger(spark, folder), fields).select("op", "key", "confidence", "gloss", "pos")


def ledger_valid(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ops(spark, folder).withColumn("fields", F.create_map(F.lit("entry"), F.col("key"), F.lit("gloss"), F.coalesce("gloss", F.lit(""))))
    return ledger.validate(rows).groupBy("op", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ledger_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proposals(spark, folder).filter("word is not null and conf is not null")
    side = lambda c: ledger.first_writer(rows.filter(F.col("conf") == c), ["pair", "word"], "prop_id").select("pair", "word", "gloss", "pos")
    return ledger.upsert(side("low"), side("high"), ["pair", "word"], ["gloss", "pos"])


def model_ops(spark: SparkSession, folder: str) -> DataFrame:
    roots = r.lexicon(spark, folder).filter("count >= 0 and form is not null").select(F.col("pair").alias("space"), "form", "gloss", "pos", "count")
    fixes = r.affixes(spark, folder).filter("count >= 0").select(F.col("pair").alias("space"), "form", "gloss", "req_pos", "count")
    return ledger.model_changes(roots, fixes).withColumnRenamed("space", "pair")


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of proposals as events in the order of their times, a change and, where it was accepted, its decision."""
    source = spark.readStream.schema(table(spark, folder, "gemma_proposals").schema).parquet(f"{folder}/gemma_proposals.parquet*").filter("word is not null")
    at = F.unix_micros(F.col("proposed_at").cast("timestamp")) * 2
    none = F.lit(None).cast("string")
    made = F.array(F.struct(at.alias("ordinal"), none.alias("decision")), F.struct((at + 1).alias("ordinal"), F.col("decision").alias("decision")))
    events = source.select("pair", "word", _sure().alias("confidence"), F.col("aligner_top1").alias("source"), F.explode(made).alias("e")).filter("e.decision is null and e.ordinal % 2 = 0 or e.decision = 'accept'")
    named = events.select(F.lit("lexical.sense.create").alias("op"), ledger.entry_name(F.col("pair"), F.col("word")).alias("key"), "e.ordinal", "confidence", "source", "e.decision", F.lit("human").alias("by"))
    name = f"ledger_{uuid.uuid4().hex}"
    stream.to_table(stream.ledger_stream(named), name)
    return stream.newest(spark.table(name)).select("op", "key", "confidence", "rounds_seen", "status", "locked")


def _tickets(spark: SparkSession, folder: str) -> DataFrame:
    rows = live_rows(table(spark, folder, "tickets"), "id", "updated_at")
    return rows.withColumn("priority", F.col("impact.priority")).withColumn("score", F.col("impact.score"))


def ticket_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tickets(spark, folder).filter("status in ('open', 'in_review')").select("id", "status", "priority", "score", "dependencies")
    return review.queue(rows).select("id", "status", "priority", "score", "place")


def ticket_escalated(spark: SparkSession, folder: str) -> DataFrame:
    return _tickets(spark, folder).filter(review.escalated(F.col("priority"), F.col("dependencies"), 2)).select("id", "status", "priority")


def ticket_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _tickets(spark, folder).groupingSets([["pair"], ["type"], ["status"], ["type", "status"], []], "pair", "type", "status").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n")
    )


def ticket_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tickets(spark, folder).select("id", "pair", F.element_at("target", "form").alias("form"))
    return review.linked(rows, ["pair"], "form")


def ticket_recycled(spark: SparkSession, folder: str) -> DataFrame:
    return review.recycled(_tickets(spark, folder).select("id", "status", "dependencies"))


def ticket_steps(spark: SparkSession, folder: str) -> DataFrame:
    steps = _tickets(spark, folder).select("id", F.posexplode("history").alias("at", "h")).select("id", "at", "h.from_status", "h.to_status")
    return review.check_steps(steps)


def ticket_impact(spark: SparkSession, folder: str) -> DataFrame:
    forms = _tickets(spark, folder).select("pair", F.lower(F.element_at("target", "form")).alias("form")).filter("form is not null")
    return review.impact(forms, r.vocabulary(spark, folder), ["pair"])


def ticket_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    each = _tickets(spark, folder).select("pair", F.explode("hypotheses").alias("h")).filter("h is not null")
    good = F.col("h.verdict.acceptable")
    return each.groupBy("pair", F.col("h.mechanism").alias("mechanism")).agg(
        F.count(F.lit(1)).alias("n"), F.count("h.verdict").alias("judged"), F.sum(F.when(good, 1).otherwise(0)).alias("acceptable"), F.sum("h.verdict.net").alias("net")
    )


def open_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs for which a paradigm is unlocked: suffixing or mixed, with case marked."""
    polarity = detect.affix_polarity(r.affixes(spark, folder), ["pair"])
    marked = r.markers(spark, folder, "pair", "features").filter(F.map_contains_key("features", F.lit("Case"))).select("pair").distinct().withColumn("case", F.lit("true"))
    rows = polarity.join(marked, "pair", "left").withColumn("switches", F.create_map(F.lit("polarity"), "polarity", F.lit("case"), F.coalesce("case", F.lit("false"))))
    rows = rows.withColumn("statuses", F.create_map(F.lit("noun_class"), F.lit("done")))
    spec = "switch:polarity == suffixing and switch:case == true or switch:polarity ~ both and paradigm:noun_class in {done, review}"
    return rows.filter(gates.gate(spec)).select("pair", "polarity")


def language_switches(spark: SparkSession, folder: str) -> DataFrame:
    words, fixes = r.vocabulary(spark, folder), r.affixes(spark, folder)
    parts = [switches.polarity(fixes, ["pair"]), switches.reduplication(words, ["pair"]), switches.infixation(words, ["pair"]), switches.gender_or_noun_class(words, fixes, ["pair"])]
    return switches.sweep(parts, None, ["pair"]).select("pair", "switch", "value", "confidence", "support")


def alternating_affixes(spark: SparkSession, folder: str) -> DataFrame:
    near = grammar.near_affixes(spark, folder)
    made = near.withColumn("z", switches.alternating_segment(F.col("left"), F.col("right")))
    return made.select("pair", "left", "right", F.array_join("z.changed", "").alias("changed"), "z.vocalic")


P = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY proposed_at DESC) AS k FROM gemma_proposals) WHERE k = 1)"
T = "t AS (SELECT *, impact.priority AS priority, impact.score AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM tickets) WHERE k = 1)"
CONF = "CASE conf WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE WHEN 'low' THEN 0.3::DOUBLE END"
OPS = f"o AS (SELECT 'lexical.sense.create' AS op, 'entry:' || pair || ':' || word AS key, {CONF} AS confidence, aligner_top1 AS source, prop_id * 2 AS ordinal, gloss, pos FROM p WHERE word IS NOT NULL)"
CONCUR = r"coalesce(conf = 'high' AND list_contains(regexp_extract_all(lower(gloss), '[\p{L}\p{N}_]+'), lower(aligner_top1)), false)"
MERGED = """g AS (SELECT op, key, CASE WHEN count(*) = 1 THEN max(confidence) ELSE coalesce(max(confidence), 0) END AS confidence, count(*) AS rounds_seen, coalesce(string_agg(source, '|' ORDER BY ordinal) FILTER (source <> ''), '') AS provenance,
arg_min(gloss, ordinal) FILTER (gloss <> '') AS gloss, arg_min(pos, ordinal) FILTER (pos <> '') AS pos FROM o GROUP BY 1, 2)"""
STATUS = "CASE WHEN confidence >= 0.85 THEN 'accepted' WHEN confidence >= 0.5 THEN 'review' ELSE 'deferred' END"

# decisions lock a signature that is there by then: what comes later counts, but alters nothing
LOCKED = """d AS (SELECT 'entry:' || pair || ':' || word AS key, prop_id * 2 + 1 AS t FROM p WHERE word IS NOT NULL AND decision = 'accept'),
q AS (SELECT * FROM o WHERE gloss <> ''),
z AS (SELECT d.key, min(t) AS lock FROM d JOIN (SELECT key, min(ordinal) AS f FROM q GROUP BY 1) USING (key) WHERE t >= f GROUP BY 1),
h AS (SELECT op, q.key AS key, any_value(lock) AS lock, count(*) AS rounds_seen, count(*) FILTER (lock IS NULL OR ordinal <= lock) AS k, max(confidence) FILTER (lock IS NULL OR ordinal <= lock) AS c,
  arg_min(gloss, ordinal) FILTER (lock IS NULL OR ordinal <= lock) AS gloss, arg_min(pos, ordinal) FILTER (pos <> '' AND (lock IS NULL OR ordinal <= lock)) AS pos FROM q LEFT JOIN z ON z.key = q.key GROUP BY 1, 2),
i AS (SELECT op, key, CASE WHEN k = 1 THEN c ELSE coalesce(c, 0) END AS confidence, rounds_seen, lock IS NOT NULL AS locked, gloss, pos FROM h)"""
# the same with the even proposals before the odd ones
RESUMED = LOCKED.replace("prop_id * 2 + 1 AS t FROM p", "prop_id * 2 + 1 + (prop_id % 2) * 1000000000 AS t FROM p").replace("q AS (SELECT * FROM o WHERE", "q AS (SELECT * REPLACE (ordinal + (ordinal // 2 % 2) * 1000000000 AS ordinal) FROM o WHERE")
DECIDED = f"CASE WHEN locked THEN 'accepted' ELSE {STATUS} END"

SQL = {
    "auto_accept": with_(P, body=f"SELECT pair, conf, count(*) AS n, sum(CASE WHEN {CONCUR} THEN 1 ELSE 0 END) AS accepted FROM p GROUP BY 1, 2"),
    "accept_precision": with_(P, body=f"""SELECT pair, sum(a) AS accepted, sum(a * r) AS "right", round(sum(a * r) / nullif(sum(a), 0), 6) AS precision FROM (
SELECT pair, CASE WHEN {CONCUR} THEN 1 ELSE 0 END AS a, CASE WHEN decision = 'accept' THEN 1 ELSE 0 END AS r FROM p WHERE decision IS NOT NULL) GROUP BY 1"""),
    "ledger_merge": with_(P, OPS, MERGED, body="SELECT op, key, confidence, rounds_seen, 'deferred' AS status, provenance, gloss, pos FROM g"),
    "ledger_decide": with_(P, OPS, LOCKED, body=f"SELECT op, key, confidence, rounds_seen, {DECIDED} AS status, locked, CASE WHEN locked THEN 'human' END AS decided_by, gloss FROM i"),
    "ledger_resumed": with_(P, OPS, RESUMED, body=f"SELECT op, key, confidence, rounds_seen, {DECIDED} AS status, locked, gloss FROM i"),
    "ledger_summary": with_(P, OPS, LOCKED, body=f"""SELECT 'status' AS "of", {DECIDED} AS value, count(*) AS n FROM i GROUP BY 1, 2 UNION ALL SELECT 'family', split_part(op, '.', 1), count(*) FROM i GROUP BY 1, 2
UNION ALL SELECT 'locked', CASE WHEN locked THEN 'true' ELSE 'false' END, count(*) FROM i GROUP BY 1, 2"""),
    "ledger_accepted": with_(P, OPS, LOCKED, body=f"SELECT op, key, confidence, gloss, pos FROM i WHERE {DECIDED} = 'accepted'"),
    "ledger_route": with_(P, OPS, LOCKED, body=f"SELECT CASE WHEN locked THEN 'locked' ELSE {STATUS} END AS status, count(*) AS n FROM i GROUP BY 1"),
    "ledger_valid": with_(P, OPS, body="SELECT op, CASE WHEN key = '' THEN 'missing field: entry' WHEN coalesce(gloss, '') = '' THEN 'missing field: gloss' ELSE 'valid' END AS reason, count(*) AS n FROM o GROUP BY 1, 2"),
    "ledger_upsert": with_(P, body="""SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.word, b.word) AS word, coalesce(b.gloss, a.gloss) AS gloss, coalesce(b.pos, a.pos) AS pos FROM
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, word ORDER BY prop_id) AS z FROM p WHERE word IS NOT NULL AND conf = 'low') WHERE z = 1) a FULL JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, word ORDER BY prop_id) AS z FROM p WHERE word IS NOT NULL AND conf = 'high') WHERE z = 1) b ON a.pair = b.pair AND a.word = b.word"""),
    "model_ops": with_(L, A, body="""SELECT 'lexical.entry.create' AS op, pair, pair || '=' || form AS key, NULL::VARCHAR AS gloss, NULL::VARCHAR AS pos, round(least(0.9, 0.3 + 0.12 * log10("count" + 1)), 3) AS confidence FROM l WHERE "count" >= 0 AND form IS NOT NULL
UNION ALL SELECT 'lexical.sense.create', pair, 'entry:' || pair || ':' || form, gloss, NULL, 0.4 FROM l WHERE "count" >= 0 AND form IS NOT NULL AND gloss NOT IN ('', '?')
UNION ALL SELECT 'lexical.entry.set_pos', pair, 'entry:' || pair || ':' || form, NULL, pos, 0.5 FROM l WHERE "count" >= 0 AND form IS NOT NULL AND pos <> ''
UNION ALL SELECT 'morphophonology.affix.add', pair, form, gloss, req_pos, round(round(least(0.9, 0.3 + 0.12 * log10("count" + 1)), 3) * 0.7, 3) FROM a WHERE "count" >= 0"""),
    "ledger_stream": f"""WITH o AS (SELECT 'lexical.sense.create' AS op, 'entry:' || pair || ':' || word AS key, {CONF} AS confidence, epoch_us(proposed_at) AS t, decision FROM gemma_proposals WHERE word IS NOT NULL),
z AS (SELECT key, min(t) AS lock FROM o WHERE decision = 'accept' GROUP BY 1),
i AS (SELECT op, o.key AS key, CASE WHEN count(*) FILTER (lock IS NULL OR t <= lock) = 1 THEN max(confidence) FILTER (lock IS NULL OR t <= lock) ELSE coalesce(max(confidence) FILTER (lock IS NULL OR t <= lock), 0) END AS confidence,
  count(*) AS rounds_seen, any_value(lock) IS NOT NULL AS locked FROM o LEFT JOIN z ON z.key = o.key GROUP BY 1, 2)
SELECT op, key, confidence, rounds_seen, {DECIDED} AS status, locked FROM i""",
    "ticket_queue": with_(T, body="""SELECT id, status, priority, score, row_number() OVER (PARTITION BY status ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
score DESC NULLS LAST, coalesce(len(dependencies), 0) DESC, id) AS place FROM t WHERE status IN ('open', 'in_review')"""),
    "ticket_escalated": with_(T, body="SELECT id, status, priority FROM t WHERE coalesce(priority = 'high', false) OR coalesce(len(dependencies), 0) >= 2"),
    "ticket_counts": with_(T, body="SELECT pair, type, status, grouping_id(pair, type, status) AS level, count(*) AS n FROM t GROUP BY GROUPING SETS ((pair), (type), (status), (type, status), ())"),
    "ticket_links": with_(T, body="""SELECT id, n - 1 AS links FROM (SELECT id, pair, left(target['form'], 4) AS h FROM t WHERE length(target['form']) >= 4)
JOIN (SELECT pair, left(target['form'], 4) AS h, count(DISTINCT id) AS n FROM t WHERE length(target['form']) >= 4 GROUP BY 1, 2) USING (pair, h)"""),
    "ticket_recycled": with_(T, body="""SELECT DISTINCT x.id, resolved FROM (SELECT id, unnest(dependencies) AS resolved FROM t WHERE status IN ('open', 'in_review')) x JOIN t ON t.id = resolved AND t.status = 'resolved'"""),
    "ticket_steps": with_(T, body="""SELECT id, count(*) AS steps, sum(CASE WHEN (f || '>' || g) IN ('open>in_review', 'in_review>resolved', 'in_review>wont_fix', 'resolved>open', 'wont_fix>open', 'open>resolved', 'open>wont_fix') AND coalesce(b = f, true) THEN 0 ELSE 1 END) AS broken FROM (
SELECT id, history[i].from_status AS f, history[i].to_status AS g, lag(history[i].to_status) OVER (PARTITION BY id ORDER BY i) AS b FROM (SELECT id, history, unnest(generate_series(1, len(history))) AS i FROM t)) GROUP BY id"""),
    "ticket_impact": with_(T, M, W, V, body="""SELECT pair, form, freq, related, affected, CASE WHEN freq + affected >= 200 THEN 'high' WHEN freq + affected >= 30 THEN 'medium' ELSE 'low' END AS priority FROM (
SELECT f.pair, f.form, coalesce(v.n, 0) AS freq, CASE WHEN length(f.form) >= 4 THEN coalesce(g.c, 0) - (v.n IS NOT NULL)::INT ELSE 0 END AS related, CASE WHEN length(f.form) >= 4 THEN coalesce(g.n, 0) - coalesce(v.n, 0) ELSE 0 END AS affected
FROM (SELECT DISTINCT pair, lower(target['form']) AS form FROM t WHERE target['form'] IS NOT NULL) f LEFT JOIN v ON v.pair = f.pair AND v.word = f.form
LEFT JOIN (SELECT pair, left(word, 4) AS h, count(*) AS c, sum(n) AS n FROM v WHERE length(word) >= 4 GROUP BY 1, 2) g ON g.pair = f.pair AND g.h = left(f.form, 4) AND length(f.form) >= 4)"""),
    "ticket_verdicts": with_(T, body="""SELECT pair, h.mechanism AS mechanism, count(*) AS n, count(h.verdict) AS judged, sum(CASE WHEN h.verdict.acceptable THEN 1 ELSE 0 END) AS acceptable, sum(h.verdict.net) AS net
FROM (SELECT pair, unnest(hypotheses) AS h FROM t) WHERE h IS NOT NULL GROUP BY 1, 2"""),
    "language_switches": with_(M, W, V, A, """ws AS (SELECT DISTINCT pair FROM v), w2 AS (SELECT pair, word FROM v WHERE n >= 2),
pol AS (SELECT pair, count(*) FILTER (kind = 'prefix') AS p, count(*) FILTER (kind = 'suffix') AS s FROM a GROUP BY 1),
rd AS (SELECT pair, count(DISTINCT word) AS c FROM (
  SELECT pair, word, left(word, k) AS b FROM (SELECT pair, word, unnest(generate_series(2, length(word) // 2)) AS k FROM v WHERE n >= 2 AND length(word) >= 4 AND NOT contains(word, '-')) WHERE left(word, k) = substr(word, k + 1, k)
  UNION ALL SELECT pair, word, substr(word, k + 1) FROM (SELECT pair, word, unnest(generate_series(2, length(word) // 2)) AS k FROM v WHERE n >= 2 AND length(word) >= 4 AND NOT contains(word, '-')) WHERE left(word, k) = substr(word, k + 1, k)
  UNION ALL SELECT pair, word, split_part(word, '-', 1) FROM v WHERE n >= 2 AND length(word) >= 4 AND contains(word, '-') AND split_part(word, '-', 1) <> '' AND word = split_part(word, '-', 1) || '-' || split_part(word, '-', 1)) x
  WHERE (pair, b) IN (SELECT pair, word FROM v) GROUP BY 1),
ic AS (SELECT pair, substr(word, 2, 2) AS chunk, count(DISTINCT left(word, 1) || substr(word, 4)) AS c FROM v WHERE length(word) >= 5
  AND (pair, left(word, 1) || substr(word, 4)) IN (SELECT pair, word FROM v WHERE n >= 2 AND length(word) BETWEEN 3 AND 9) GROUP BY 1, 2),
ix AS (SELECT pair, list(c ORDER BY c DESC) AS cs FROM ic GROUP BY 1),
gp AS (SELECT pair, count(*) AS c FROM w2 WHERE length(word) > 2 AND word LIKE '%o' AND (pair, left(word, length(word) - 1) || 'a') IN (SELECT pair, word FROM w2) GROUP BY 1),
st AS (SELECT DISTINCT w2.pair, substr(word, length(form) + 1) AS stem, form FROM w2 JOIN a ON a.pair = w2.pair AND a.kind = 'prefix' AND length(form) BETWEEN 1 AND 3 AND starts_with(word, form) AND length(word) > length(form) + 2
  WHERE (w2.pair, substr(word, length(form) + 1)) IN (SELECT pair, word FROM w2)),
mu AS (SELECT pair, stem FROM st GROUP BY 1, 2 HAVING count(*) >= 2),
nm AS (SELECT pair, count(*) AS c FROM mu GROUP BY 1),
ld AS (SELECT pair, count(*) AS c FROM (SELECT st.pair, form FROM st JOIN mu ON mu.pair = st.pair AND mu.stem = st.stem GROUP BY 1, 2 HAVING count(*) >= 8) GROUP BY 1),
gn AS (SELECT ws.pair, coalesce(gp.c, 0) AS g, coalesce(nm.c, 0) AS m, coalesce(nm.c, 0) >= 24 AND coalesce(ld.c, 0) >= 4 AND coalesce(nm.c, 0) >= coalesce(gp.c, 0) AS nc FROM ws LEFT JOIN gp USING (pair) LEFT JOIN nm USING (pair) LEFT JOIN ld USING (pair))""", body="""
SELECT pair, 'affix_polarity' AS switch, CASE WHEN p > s * 1.3 THEN 'prefixing' WHEN s > p * 1.3 THEN 'suffixing' ELSE 'both' END AS value, round(0.5 + least(0.4, abs(p - s) / greatest(p + s, 1)), 2) AS confidence, p + s AS support FROM pol
UNION ALL SELECT ws.pair, 'reduplication', CASE WHEN coalesce(c, 0) >= 8 THEN 'true' ELSE 'false' END, round(0.5 + least(0.4, coalesce(c, 0) / 30), 2), coalesce(c, 0) FROM ws LEFT JOIN rd USING (pair)
UNION ALL SELECT ws.pair, 'infixation', CASE WHEN coalesce(cs[1], 0) >= 8 AND (len(cs) < 3 OR cs[1] >= 3 * greatest(cs[len(cs) // 2 + 1], 1)) THEN 'true' ELSE 'false' END, CASE WHEN cs IS NULL THEN 0.55 ELSE round(0.5 + least(0.4, cs[1] / 40), 2) END, coalesce(cs[1], 0) FROM ws LEFT JOIN ix USING (pair)
UNION ALL SELECT pair, 'gender_or_noun_class', CASE WHEN nc THEN 'noun-class' WHEN g >= 8 THEN 'gender' ELSE 'none' END, CASE WHEN nc THEN 0.7 WHEN g >= 8 THEN 0.65 ELSE 0.55 END, CASE WHEN nc THEN m ELSE g END FROM gn"""),
    "alternating_affixes": with_(A, body=f"""SELECT pair, "left", "right", array_to_string(changed, '') AS changed, len(list_filter(changed, lambda k: contains('aeiou', k))) > 0 AS vocalic FROM (
SELECT *, list_sort(list_concat(list_filter(c, lambda k: NOT list_contains(d, k)), list_filter(d, lambda k: NOT list_contains(c, k)))) AS changed FROM (
SELECT *, list_distinct(regexp_extract_all("left", '.')) AS c, list_distinct(regexp_extract_all("right", '.')) AS d FROM ({grammar.NEAR.format(t="a")})))"""),
    "open_gates": with_(M, A, body="""SELECT pair, polarity FROM (SELECT *, CASE WHEN prefixes > 1.3 * suffixes THEN 'prefixing' WHEN suffixes > 1.3 * prefixes THEN 'suffixing' ELSE 'both' END AS polarity FROM (
SELECT pair, count(*) FILTER (kind = 'prefix') AS prefixes, count(*) FILTER (kind = 'suffix') AS suffixes FROM a GROUP BY pair))
WHERE polarity = 'both' OR polarity = 'suffixing' AND pair IN (SELECT pair FROM m WHERE list_contains(map_keys(features), 'Case'))"""),
}

QUERIES = {f.__name__: f for f in (
    auto_accept, accept_precision, ledger_merge, ledger_decide, ledger_route, ledger_resumed, ledger_summary, ledger_accepted, ledger_valid, ledger_upsert, model_ops, ledger_stream, ticket_queue, ticket_escalated, ticket_counts, ticket_links, ticket_recycled,
    ticket_steps, ticket_impact, ticket_verdicts, open_gates, language_switches, alternating_affixes,
)}
