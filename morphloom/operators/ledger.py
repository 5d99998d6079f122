"""An idempotent ledger of proposed changes: the contract of changes, signatures, merging, deciding, routing, and what was accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From these confidences on a proposal is accepted, or reviewed; below it is deferred.
ACCEPT_AT, REVIEW_AT = 0.85, 0.5

# Kinds of change and the fields each must have.
REQUIRED = {
    "lexical.entry.create": ("lexeme_form", "morph_type"),
    "lexical.sense.create": ("entry", "gloss"),
    "lexical.entry.add_allomorph": ("entry", "form"),
    "lexical.entry.set_pos": ("entry", "pos"),
    "lexical.pronunciation.create": ("entry", "form"),
    "morphophonology.affix.add": ("form", "gram"),
    "morphophonology.allomorph.add": ("morpheme", "form"),
    "morphophonology.rule.add": ("name", "rule"),
    "morphophonology.natural_class.add": ("name", "members"),
    "bilingual.sense_link.add": ("vernacular_sense", "reference_lemma"),
    "bilingual.sense_link.remove": ("vernacular_sense", "reference_lemma"),
}
# The field that is the key of each kind of change.
KEY_FIELD = {
    "lexical.entry.create": "lexeme_form",
    "lexical.sense.create": "entry",
    "lexical.entry.add_allomorph": "form",
    "lexical.entry.set_pos": "entry",
    "lexical.pronunciation.create": "entry",
    "morphophonology.affix.add": "form",
    "morphophonology.allomorph.add": "form",
    "morphophonology.rule.add": "name",
    "morphophonology.natural_class.add": "name",
    "bilingual.sense_link.add": "reference_lemma",
    "bilingual.sense_link.remove": "reference_lemma",
}
# Fields of a ledger row that a later change may fill.
FILLED = ("gloss", "pos", "gram", "rationale")


def signature(op: Column, key: Column) -> Column:
    """The identity of a change: its kind and key; a missing key is the empty one."""
    return F.concat_ws("|", op, F.coalesce(key, F.lit("")))


def map_key(value: Column) -> Column:
    """The key text of a map: sorted ``k=v`` joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def key_of(op: Column, fields: Column) -> Column:
    """The key of a change: its key field, a JSON object there as ``map_key``; an unknown kind or missing field has the empty key."""
    value = F.lit(None).cast("string")
    for kind, name in KEY_FIELD.items():
        value = F.when(op == kind, F.element_at(fields, F.lit(name))).otherwise(value)
    entries = F.from_json(value, "map<string,string>")
    return F.coalesce(F.when(value.startswith("{") & entries.isNotNull(), map_key(entries)).otherwise(value), F.lit(""))


def _empty(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")).isin("", "[]", "{}") & (F.coalesce(value, F.lit("")).isin("", "[]", "{}"))


def validate(ops: DataFrame, op: str = "op", fields: str = "fields", confidence: str = "confidence") -> DataFrame:
    """``ops`` with column reason: null if the change is valid, else what is wrong with it first.

    fields is a map of text, lists and objects in it as JSON. Checked in order: the
    kind is known, its fields are there and not empty, the confidence lies within 0..1.
    """
    missing = F.lit(None).cast("string")
    for kind, needed in REQUIRED.items():
        for name in reversed(needed):
            missing = F.when((F.col(op) == kind) & _empty(F.element_at(F.col(fields), F.lit(name))), F.lit(f"missing field: {name}")).otherwise(missing)
    sure = F.col(confidence)
    reason = (
        F.when(F.col(op).isNull() | ~F.col(op).isin(list(REQUIRED)), F.concat(F.lit("unknown op: "), F.coalesce(F.col(op), F.lit(""))))
        .when(missing.isNotNull(), missing)
        .when(sure.isNotNull() & ~sure.between(0.0, 1.0), "confidence out of range")
    )
    return ops.withColumn("reason", reason)


def route_status(confidence: Column, accept_at: float = ACCEPT_AT, review_at: float = REVIEW_AT) -> Column:
    """accepted, review or deferred by confidence; null is deferred."""
    return F.when(confidence >= accept_at, "accepted").when(confidence >= review_at, "review").otherwise("deferred")


def merge_changes(ops: DataFrame, order: str, fill: list[str] | tuple[str, ...] = FILLED, state: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """The ledger after changes and decisions: one row for each signature.

    (op, key, confidence, rounds_seen, status, locked, decided_by, provenance, fill columns)

    ops: (op, key, confidence, source, order column, fill columns). Of changes with
    one signature the highest confidence counts (a null one is 0 beside others),
    each fill column has its first value that is neither null nor empty, sources
    that are not null are listed in order. A row starts as deferred.
    decisions: (op, key, decision, by, order column). A decision on a signature
    that the ledger has by then locks its row: accepted if it is ``accept``, else
    rejected; of several the last stays. A change that comes after a lock is
    counted and its source listed, but alters nothing else.
    state: a ledger from before; everything in it came first.

    Sums, maxima and firsts are made before the exchange, so a signature of very
    many changes is reduced where it is read.
    """
    early = F.col(order).cast("bigint")
    fill = list(fill)
    news = ops.select("op", "key", "confidence", F.when(F.col("source") != "", F.col("source")).alias("source"), early.alias("__at"), *fill)
    first = news.groupBy("op", "key").agg(F.min("__at").alias("__first"))
    locks, last = None, None
    if decisions is not None:
        known = first if state is None else first.unionByName(state.select("op", "key", F.lit(-(1 << 62)).alias("__first"))).groupBy("op", "key").agg(F.min("__first").alias("__first"))
        made = decisions.select("op", "key", "decision", "by", early.alias("__when")).join(known, ["op", "key"]).filter("__when >= __first")
        last = made.groupBy("op", "key").agg(F.min("__when").alias("__lock"), F.max_by("decision", "__when").alias("decision"), F.max_by("by", "__when").alias("by"))
        locks = last.select("op", "key", "__lock")
    if state is not None:
        held = state.filter("locked").select("op", "key", F.lit(-(1 << 62)).alias("__lock"))
        locks = held if locks is None else locks.unionByName(held).groupBy("op", "key").agg(F.min("__lock").alias("__lock"))
    open_ = F.lit(True)
    if locks is not None:
        news = news.join(locks, ["op", "key"], "left")
        open_ = F.col("__lock").isNull() | (F.col("__at") <= F.col("__lock"))
    truthy = lambda c: F.when(open_ & F.col(c).isNotNull() & (F.col(c) != ""), F.col("__at"))
    merged = news.groupBy("op", "key").agg(
        F.count(F.lit(1)).alias("rounds_seen"),
        F.sum(open_.cast("bigint")).alias("__open"),
        F.max(F.when(open_, F.col("confidence"))).alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("__at", "source")))), lambda x: x["source"]).alias("provenance"),
        *[F.min_by(F.col(c), truthy(c)).alias(c) for c in fill],
    )
    several = F.when(F.col("__open") == 1, F.col("confidence")).when(F.col("__open") > 1, F.coalesce("confidence", F.lit(0.0)))
    merged = merged.withColumn("confidence", several)
    if state is None:
        out = merged.select("op", "key", "confidence", "rounds_seen", F.lit("deferred").alias("status"), F.lit(False).alias("locked"), F.lit(None).cast("string").alias("decided_by"), "provenance", *fill)
    else:
        o, n = state.alias("o"), merged.alias("n")
        same = F.col("o.op").eqNullSafe(F.col("n.op")) & F.col("o.key").eqNullSafe(F.col("n.key"))
        both, more = F.col("o.rounds_seen").isNotNull() & F.col("n.rounds_seen").isNotNull(), F.coalesce("n.__open", F.lit(0)) > 0
        sure = F.when(both & more, F.greatest(F.coalesce("o.confidence", F.lit(0.0)), F.coalesce("n.confidence", F.lit(0.0)))).otherwise(F.coalesce("o.confidence", "n.confidence"))
        nothing = F.array().cast("array<string>")
        out = o.join(n, same, "full_outer").select(
            F.coalesce("o.op", "n.op").alias("op"), F.coalesce("o.key", "n.key").alias("key"),
            sure.alias("confidence"), (F.coalesce("o.rounds_seen", F.lit(0)) + F.coalesce("n.rounds_seen", F.lit(0))).alias("rounds_seen"),
            F.coalesce("o.status", F.lit("deferred")).alias("status"), F.coalesce("o.locked", F.lit(False)).alias("locked"), F.col("o.decided_by").alias("decided_by"),
            F.concat(F.coalesce("o.provenance", nothing), F.coalesce("n.provenance", nothing)).alias("provenance"),
            *[F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}")).alias(c) for c in fill],
        )
    return out if last is None else _decided(out, last)


def decide(ledger: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """The ledger with decisions (op, key, decision, by, order column) on its rows, the last of each signature; others are no rows."""
    last = decisions.groupBy("op", "key").agg(F.max_by("decision", order).alias("decision"), F.max_by("by", order).alias("by"))
    return _decided(ledger, last)


def _decided(ledger: DataFrame, last: DataFrame) -> DataFrame:
    """Rows whose signature is in ``last`` are locked; the rest stay."""
    named = last.select("op", "key", "decision", "by", F.lit(True).alias("__made"))
    joined = ledger.join(named, ["op", "key"], "left").withColumn("__made", F.coalesce("__made", F.lit(False)))
    verdict = F.when(F.col("decision") == "accept", "accepted").otherwise("rejected")
    made = {"status": F.when(F.col("__made"), verdict).otherwise(F.col("status")), "locked": F.col("locked") | F.col("__made"), "decided_by": F.when(F.col("__made"), F.col("by")).otherwise(F.col("decided_by"))}
    return joined.withColumns(made).select(*ledger.columns)


def route(ledger: DataFrame, accept_at: float = ACCEPT_AT, review_at: float = REVIEW_AT) -> DataFrame:
    """The ledger with the status of every row that is not locked set from its confidence."""
    return ledger.withColumn("status", F.when(F.col("locked"), F.col("status")).otherwise(route_status(F.col("confidence"), accept_at, review_at)))


def route_tally(ledger: DataFrame) -> DataFrame:
    """(status, n): how many rows routing gave each status; locked ones count as locked alone."""
    return ledger.groupBy(F.when(F.col("locked"), "locked").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def by_status(ledger: DataFrame, status: str) -> DataFrame:
    """The rows of a status, the surest first."""
    return ledger.filter(F.col("status") == status).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "op", "key")


def summary(ledger: DataFrame) -> DataFrame:
    """(of, value, n): rows by status, by the family of their kind, and the locked ones."""
    facts = F.array(
        F.struct(F.lit("status").alias("of"), F.coalesce("status", F.lit("?")).alias("value")),
        F.struct(F.lit("family").alias("of"), F.split_part(F.coalesce("op", F.lit("?")), F.lit("."), F.lit(1)).alias("value")),
        F.struct(F.lit("locked").alias("of"), F.col("locked").cast("string").alias("value")),
    )
    return ledger.select(F.explode(facts).alias("x")).groupBy("x.of", "x.value").agg(F.count(F.lit(1)).alias("n"))


def accepted_changes(ledger: DataFrame, fields: Column) -> DataFrame:
    """The accepted rows as changes, without what the ledger adds to them. ``fields`` gives the map that ``validate`` reads; an invalid row fails the job."""
    rows = validate(ledger.filter(F.col("status") == "accepted").withColumn("fields", fields))
    checked = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("an accepted change is invalid: "), "reason")).cast("string")).otherwise(F.col("op"))
    return rows.withColumn("op", checked).drop("reason", "status", "rounds_seen", "locked", "decided_by")


def changes_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, at, op, fields, confidence, reason): the changes in a JSON text, an object with ``ops`` or a list, with or without code fences.

    A text that is neither has one row without op, whose reason says so.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"\n?```[^\n]*\s*$", "")
    listed = F.when(bare.startswith("["), bare).otherwise(F.get_json_object(bare, "$.ops"))
    ops = F.from_json(listed, T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    rows = df.select(*keys, F.posexplode_outer(ops).alias("at", "fields"), (ops.isNull()).alias("__none"))
    named = rows.select(*keys, "at", F.element_at("fields", F.lit("op")).alias("op"), "fields", F.element_at("fields", F.lit("confidence")).try_cast("double").alias("confidence"), "__none")
    reason = F.when(F.col("__none"), "no list of changes").when(F.element_at("fields", F.lit("confidence")).isNotNull() & F.col("confidence").isNull(), "confidence out of range").otherwise(F.col("reason"))
    return validate(named).withColumn("reason", reason).filter("__none or fields is not null").drop("__none")


def upsert(state: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``state`` with the rows of ``new``: a new non-null value replaces an old one, other old values stay. Keys are unique on each side."""
    s, n = state.alias("s"), new.alias("n")
    same = None
    for k in keys:
        one = F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = one if same is None else same & one
    joined = s.join(n, same, "full_outer")
    return joined.select(*[F.coalesce(f"s.{k}", f"n.{k}").alias(k) for k in keys], *[F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in columns])


def first_writer(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by the order column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__k", place).filter("__k = 1").drop("__k")


def gloss_confidence(count: Column) -> Column:
    """Confidence from a frequency: 0.3 + 0.12 log10(n + 1), at most 0.9, to three places."""
    return F.round(F.least(F.lit(0.9), F.lit(0.3) + F.lit(0.12) * F.log10(count + 1)), 3)


def entry_name(space: Column, form: Column) -> Column:
    """The identifier of an entry."""
    return F.concat(F.lit("entry:"), space, F.lit(":"), form)


def model_changes(roots: DataFrame, affixes: DataFrame, word_prob: DataFrame | None = None) -> DataFrame:
    """A grammar as changes (op, space, key, gloss, pos, confidence).

    Each root (space, form, gloss, pos, count) gives an entry, a sense if its gloss
    is known (confidence: the alignment's probability of the form in ``word_prob``
    (space, form, prob), 0.4 without one) and a part of speech (0.5). Each affix
    (space, form, gloss, req_pos, count) gives an affix, at 0.7 of an entry's confidence.
    """
    named = roots.withColumn("entry", entry_name(F.col("space"), F.col("form")))
    prob = F.lit(0.4)
    if word_prob is not None:
        named = named.join(word_prob.select("space", "form", F.col("prob").alias("__prob")), ["space", "form"], "left")
        prob = F.coalesce("__prob", F.lit(0.4))
    none = F.lit(None).cast("string")
    known, placed = F.col("gloss").isNotNull() & ~F.col("gloss").isin("", "?"), F.col("pos").isNotNull() & (F.col("pos") != "")
    made = F.array_compact(F.array(
        F.struct(F.lit("lexical.entry.create").alias("op"), F.concat("space", F.lit("="), "form").alias("key"), none.alias("gloss"), none.alias("pos"), gloss_confidence(F.col("count")).alias("confidence")),
        F.when(known, F.struct(F.lit("lexical.sense.create").alias("op"), F.col("entry").alias("key"), F.col("gloss").alias("gloss"), none.alias("pos"), F.round(prob, 3).alias("confidence"))),
        F.when(placed, F.struct(F.lit("lexical.entry.set_pos").alias("op"), F.col("entry").alias("key"), none.alias("gloss"), F.col("pos").alias("pos"), F.lit(0.5).alias("confidence"))),
    ))
    entries = named.select("space", F.explode(made).alias("x")).select("x.op", "space", "x.key", "x.gloss", "x.pos", "x.confidence")
    fixes = affixes.select(F.lit("morphophonology.affix.add").alias("op"), "space", F.col("form").alias("key"), "gloss", F.col("req_pos").alias("pos"), F.round(gloss_confidence(F.col("count")) * 0.7, 3).alias("confidence"))
    return entries.unionByName(fixes)
