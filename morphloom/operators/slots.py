"""Verb slots, case markers and voice from projected annotations. Projected rows: (row, at, word, role, pos, feats, head_word)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphloom.operators.project import first_marker, subject_verbs
from morphloom.operators.stats import modal


def subject_marking(projected: DataFrame, class_prefixes: list[str], longest: int = 2, least: int = 8, top: int = 4) -> DataFrame:
    """(prefix, marker, n, place): verb beginnings that go with each subject prefix, the most frequent first.

    The prefix is the first of ``class_prefixes`` (longest first) that the subject
    begins with, ``Ø`` without one.
    """
    ordered = sorted(class_prefixes, key=lambda p: (-len(p), p))
    prefix = F.when(first_marker(F.col("noun"), ordered) == "?", "Ø").otherwise(first_marker(F.col("noun"), ordered))
    pairs = subject_verbs(projected).filter(F.length("verb") > longest).select(prefix.alias("prefix"), F.expr(f"left(verb, {longest})").alias("marker"))
    counted = pairs.groupBy("prefix", "marker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "marker"))
    return counted.withColumn("place", place.cast("bigint")).filter(F.col("place") <= top)


def slot_counts(verbs: DataFrame, subject_markers: list[str], known: list[str], least: int = 20, width: int = 2) -> DataFrame:
    """(slot, n): what stands after the subject marker: the longest known marker, else ``width`` characters. verbs: (word)."""
    marked = verbs.withColumn("m", first_marker(F.col("word"), sorted(subject_markers, key=lambda p: (-len(p), p)))).filter("m <> '?'")
    rest = marked.withColumn("rest", F.expr("substr(word, length(m) + 1)"))
    slot = F.expr(f"left(rest, {width})")
    for one in sorted(known, key=lambda p: (len(p), p)):
        slot = F.when(F.startswith("rest", F.lit(one)), one).otherwise(slot)
    return rest.filter(f"length(rest) >= {width}").groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def object_markers(verbs: DataFrame, subject_markers: list[str], tense_markers: list[str], least: int = 15) -> DataFrame:
    """(slot, n): two characters after subject and tense marker, where at least two more follow."""
    order = lambda names: sorted(names, key=lambda p: (-len(p), p))
    after = verbs.withColumn("m", first_marker(F.col("word"), order(subject_markers))).filter("m <> '?'").withColumn("rest", F.expr("substr(word, length(m) + 1)"))
    tense = after.withColumn("t", first_marker(F.col("rest"), order(tense_markers))).filter("t <> '?'").withColumn("tail", F.expr("substr(rest, length(t) + 1)"))
    return tense.filter("length(tail) >= 4").groupBy(F.expr("left(tail, 2)").alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def class_by_subject(projected: DataFrame, markers: dict[str, str], least: int = 2) -> DataFrame:
    """(noun, noun_class, n): nouns under the class whose marker their verbs bear most often."""
    order = sorted(markers, key=lambda p: (-len(p), p))
    table = F.create_map(*[F.lit(x) for pair in markers.items() for x in pair])
    seen = subject_verbs(projected).select("noun", first_marker(F.col("verb"), order).alias("m")).filter("m <> '?'")
    return modal(seen.withColumn("noun_class", F.element_at(table, F.col("m"))), ["noun"], "noun_class", support=least).select("noun", "noun_class", "n")


def neighbour_roles(projected: DataFrame, longest: int = 4, least: int = 8, purity: float = 0.4, top: int = 6) -> DataFrame:
    """(side, marker, role, n, share, place): short words before or after nominal ones that go with one role; the side with more distinct roles only."""
    by = Window.partitionBy("row").orderBy("at")
    seen = projected.withColumns({"before": F.lag("word").over(by), "after": F.lead("word").over(by)}).filter("pos in ('NOUN', 'PRON') and role is not null")
    both = seen.select("role", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("marker")), F.struct(F.lit("after").alias("side"), F.col("after").alias("marker")))).alias("e")).select("role", "e.side", "e.marker")
    good = modal(both.filter(F.col("marker").isNotNull() & (F.length("marker") <= longest)), ["side", "marker"], "role", support=least, share=purity)
    ranked = good.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy((F.col("share") * F.col("n")).desc(), "marker")).cast("bigint")).filter(F.col("place") <= top)
    roles = ranked.groupBy("side").agg(F.countDistinct("role").alias("roles"))
    best = roles.orderBy(F.desc("roles"), "side").limit(1)
    return ranked.join(best.select("side"), "side", "left_semi").select("side", "marker", "role", "n", "share", "place")


def glossed_functions(vocabulary: DataFrame, table: DataFrame, words: dict[str, str], top: int = 40, longest: int = 4, least: float = 0.35) -> DataFrame:
    """(function, word, source, prob): frequent short words glossed by a function word: adpositions, tense words and the like.

    vocabulary: (word, n), table: first candidates (target, source, prob), words: source word -> function.
    """
    names = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    first = vocabulary.orderBy(F.desc("n"), "word").limit(top).filter(F.length("word") <= longest)
    joined = first.join(table.filter(F.col("prob") >= least).select(F.col("target").alias("word"), "source", "prob"), "word")
    return joined.withColumn("function", F.try_element_at(names, F.col("source"))).filter("function is not null").select("function", "word", "source", "prob")


def alternants(roots: DataFrame, affix: str, least: float = 0.15) -> DataFrame:
    """(affix, shared, overlap): affixes whose roots overlap with those of ``affix``: what a voice alternates with. roots: (affix, root)."""
    distinct = roots.select("affix", "root").distinct()
    own = distinct.filter(F.col("affix") == affix).select("root")
    sizes = distinct.groupBy("affix").agg(F.count(F.lit(1)).alias("size"))
    shared = distinct.filter(F.col("affix") != affix).join(own, "root", "left_semi").groupBy("affix").agg(F.count(F.lit(1)).alias("shared"))
    mine = own.agg(F.count(F.lit(1))).scalar()
    return shared.join(sizes, "affix").withColumn("overlap", F.col("shared") / F.least("size", mine)).filter(F.col("overlap") >= least).select("affix", "shared", "overlap")


def detected(hypotheses: DataFrame, keys: list[str], cells: int = 2, measure: str = "share", least: float = 0.5) -> DataFrame:
    """(keys, cells, detected): whether a trait shows: at least so many of its hypotheses are sure enough. hypotheses: (keys, measure)."""
    good = F.sum((F.col(measure) >= least).cast("int"))
    return hypotheses.groupBy(*keys).agg(good.alias("cells")).withColumn("detected", F.col("cells") >= cells)


def packet(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, packet): the evidence for a paradigm as one JSON record a key; each part is a list of its rows, in order.

    A part may hold any number of rows of a key; packets are reports of a few rows
    each, so parts should be ranked and cut before.
    """
    out = None
    for name, df in parts.items():
        rest = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*rest)))).alias(name))
        out = one if out is None else out.join(one, keys, "full_outer")
    fields = [F.concat(F.lit(f'"{n}": ['), F.coalesce(F.array_join(n, ", "), F.lit("")), F.lit("]")) for n in parts]
    return out.select(*keys, F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("packet"))


def unlock(paradigms: list[tuple[str, str]], switches: DataFrame, done: dict[str, str], rounds: int = 4) -> dict[str, list[str]]:
    """Key -> paradigms in the order they unlock: those whose gate opens, given what was done in rounds before.

    paradigms: (name, gate) by priority. switches: (key, switches map): one row a
    language, so the driver holds a few names for each.
    """
    from morphloom.operators.gates import gate

    order: dict[str, list[str]] = {r[0]: [] for r in switches.select("key").collect()}
    for _ in range(rounds):
        rows = [(k, {**done, **{p: "done" for p in v}}) for k, v in order.items()]
        if not rows:
            break
        state = switches.join(switches.sparkSession.createDataFrame(rows, "key string, statuses map<string,string>"), "key")
        opened = state.select("key", *[gate(g).alias(f"g{i}") for i, (_, g) in enumerate(paradigms)]).collect()
        moved = False
        for r in opened:
            for i, (name, _) in enumerate(paradigms):
                if r[f"g{i}"] and name not in order[r["key"]] and name not in done:
                    order[r["key"]].append(name)
                    moved = True
        if not moved:
            break
    return order
