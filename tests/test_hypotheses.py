from pyspark.sql import functions as F

from morphloom.operators import hypotheses as hy
from morphloom.operators import slots


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def projected(spark, data):
    return spark.createDataFrame(data, "row string, at int, word string, role string, pos string, feats map<string,string>, head_word string")


def test_hypotheses_by_mechanism(spark):
    words = spark.createDataFrame([("p", w) for w in ("walks", "sumulat", "walk", "walki")], "k string, word string")
    lemmas = spark.createDataFrame([("p", "walk"), ("p", "sulat")], "k string, lemma string")
    affixes = spark.createDataFrame([("p", "suffix", "s")], "k string, side string, affix string")
    got = rows(hy.hypotheses(words, lemmas, affixes, ["k"]), "word", "mechanism", "detail")
    assert {("walks", "resegment", "walk+s"), ("walks", "add_allomorph", "walk"), ("walk", "split_homograph", "walk"), ("sumulat", "infix", "um+sulat"), ("walki", "add_lexentry", "walki")} <= got
    assert not any(m in ("infix", "resegment") for _, m, _ in rows(hy.hypotheses(words, lemmas, affixes, ["k"], []), "word", "mechanism", "detail"))


def test_edits_become_changes(spark):
    data = [("add_lexentry", '{"form": "kata", "gloss": "cat", "pos": "noun"}'), ("split_homograph", '{"form": "x", "gloss": "?"}'), ("add_allomorph", '{"entry_form": "kata", "allomorph": "kat"}'), ("add_affix", '{"form": "ni", "kind": "prefix", "gloss": "1SG"}'),
            ("add_phon_rule", '{"archiphoneme": "N"}'), ("narrow_affix", '{"form": "s"}'), ("add_affix", None), ("composite", "{}"), (None, "{}"),
            ("resegment", '{"edits": [{"kind": "add_lexentry", "params": {"form": "in"}}, {"kind": "resegment", "params": {"edits": [{"kind": "retract_affix", "params": {"form": "z", "gloss": "PL"}}]}}]}')]
    edits = spark.createDataFrame([("p", i, *d) for i, d in enumerate(data)], "k string, ordinal int, kind string, params string")
    flat = hy.flat_edits(edits, ["k"])
    got = {(r.op, r.key, r.entry, r.gloss, r.pos, r.gram, r.kind, r.slot, r.rationale) for r in hy.edits_to_changes(flat, ["k"], "k").collect()}
    entry, none = lambda f: ("lexical.entry.create", f"p={f}", f"entry:p:{f}", None, None, None, None, None, None), None
    assert got == {
        entry("kata"), ("lexical.sense.create", "entry:p:kata", "entry:p:kata", "cat", none, none, none, none, none), ("lexical.entry.set_pos", "entry:p:kata", "entry:p:kata", none, "noun", none, none, none, none),
        entry("x"), ("lexical.entry.add_allomorph", "kat", "entry:p:kata", none, none, none, none, none, none), ("morphophonology.affix.add", "ni", none, none, none, "1SG", "prefix", "1", none),
        ("morphophonology.rule.add", "rule", none, none, none, "N", none, none, none), ("morphophonology.affix.add", "s", none, none, none, "s", none, none, "REPAIR/narrow_affix: review manually"),
        entry("in"), ("morphophonology.affix.add", "z", none, none, none, "PL", none, none, "REPAIR/retract_affix: review manually"),
    }
    assert [tuple(r.ordinal) for r in flat.filter("kind = 'retract_affix'").collect()] == [(9, 1, 0)]


def test_edits_change_the_grammar(spark):
    roots = spark.createDataFrame([("p", "kata", "cat", "noun", ["kat"])], "k string, form string, gloss string, pos string, allomorphs array<string>")
    affixes = spark.createDataFrame([("p", "s", "PL", "suffix", 1, ""), ("p", "s", "3SG", "suffix", 1, ""), ("p", "z", "PL", "suffix", 2, "noun")], "k string, form string, gloss string, kind string, slot int, req_pos string")
    data = [("add_affix", '{"form": "ni", "kind": "prefix"}'), ("add_allomorph", '{"entry_form": "kata", "allomorph": "kat"}'), ("add_allomorph", '{"entry_form": "kata", "allomorph": "kac"}'), ("add_allomorph", '{"entry_form": "new", "allomorph": "ne"}'),
            ("add_lexentry", '{"form": "new", "gloss": "late"}'), ("split_homograph", '{"form": "kata", "gloss": "other"}'), ("narrow_affix", '{"form": "s", "gloss": "PL", "req_pos": "noun"}'), ("narrow_affix", '{"form": "s", "slot_ord": 3}'),
            ("retract_affix", '{"form": "z"}'), ("add_affix", '{"form": "z"}'), ("add_phon_rule", '{"id": "r", "xml": "<x/>"}'), ("add_phon_rule", '{"id": "q"}')]
    edits = hy.flat_edits(spark.createDataFrame([("p", i, *d) for i, d in enumerate(data)], "k string, ordinal int, kind string, params string"), ["k"])
    out, fixes, rules = hy.apply_edits(roots, affixes, edits, ["k"])
    assert {(r.form, r.gloss, r.pos, tuple(r.allomorphs)) for r in out.collect()} == {("kata", "cat", "noun", ("kat", "kac")), ("kata", "other", "root", ()), ("new", "?", "root", ("ne",)), ("new", "late", "root", ())}
    assert {tuple(r)[1:] for r in fixes.collect()} == {("s", "PL", "suffix", "3", "noun"), ("s", "3SG", "suffix", "3", ""), ("z", "z", "suffix", "1", ""), ("ni", "ni", "prefix", "1", "")}
    assert [tuple(r) for r in rules.collect()] == [("p", "r", "<x/>")]
    same = hy.apply_edits(roots, affixes, edits.limit(0), ["k"])
    assert same[0].count() == 1 and same[1].count() == 3 and same[2].count() == 0



def test_quota_options_and_samples(spark):
    df = spark.createDataFrame([("p", "s1", i) for i in range(5)] + [("p", "s2", 9), ("p", "s3", 1)], "k string, stage string, n int")
    assert rows(hy.quota(df, ["k"], "stage", [F.desc("n")], {"s1": 2, "s2": 3}), "stage", "n") == {("s1", 4), ("s1", 3), ("s2", 9)}
    base, options = spark.createDataFrame([("p", "a"), ("p", "b")], "k string, word string"), spark.createDataFrame([("p", "o", "a"), ("p", "o", "c")], "k string, option string, word string")
    assert rows(hy.compare_options(base, options, ["k"])) == {("p", "o", 2, 1, 1)}
    tokens = spark.createDataFrame([("r1", "Kata"), ("r2", "kata"), ("r2", "x")], "ref string, word string")
    assert rows(hy.resolve_samples(spark.createDataFrame([("kata",), ("zz",)], "sample string"), tokens)) == {("kata", "matched", "r1 | r2"), ("zz", "unresolved", "")}


def test_slots_and_markers(spark):
    data = [(f"r{i}", 0, "mtoto", "nsubj", "NOUN", {}, "analala") for i in range(8)] + [(f"r{i}", 1, "analala", "ROOT", "VERB", {}, "analala") for i in range(8)]
    df = projected(spark, data)
    assert rows(slots.subject_marking(df, ["m", "wa"]), "prefix", "marker", "n") == {("m", "an", 8)}
    assert rows(slots.class_by_subject(df, {"a": "c1", "wa": "c2"}), "noun", "noun_class") == {("mtoto", "c1")}
    verbs = df.filter("pos = 'VERB'").select("word")
    assert rows(slots.slot_counts(verbs, ["a"], ["nal", "na"], 5)) == {("nal", 8)}
    longer = spark.createDataFrame([("anakupenda",)] * 3, "word string")
    assert rows(slots.object_markers(longer, ["a"], ["na"], 2)) == {("ku", 3)}


def test_neighbour_roles_and_functions(spark):
    data = []
    for i in range(8):
        data += [(f"a{i}", 0, "ke", None, "PART", {}, None), (f"a{i}", 1, f"n{i}", "obj", "NOUN", {}, None), (f"b{i}", 0, "ga", None, "PART", {}, None), (f"b{i}", 1, f"n{i}", "nsubj", "NOUN", {}, None)]
    got = rows(slots.neighbour_roles(projected(spark, data)), "side", "marker", "role", "share")
    assert got == {("before", "ke", "obj", 1.0), ("before", "ga", "nsubj", 1.0)}
    vocabulary, table = spark.createDataFrame([("na", 9), ("kwa", 8), ("longer", 7)], "word string, n int"), spark.createDataFrame([("na", "with", 0.6), ("kwa", "dog", 0.9)], "target string, source string, prob double")
    assert rows(slots.glossed_functions(vocabulary, table, {"with": "comitative"}), "function", "word") == {("comitative", "na")}
    roots = spark.createDataFrame([("pass", "a"), ("pass", "b"), ("act", "a"), ("act", "c"), ("x", "z")], "affix string, root string")
    assert rows(slots.alternants(roots, "pass")) == {("act", 1, 0.5)}


def test_packets_and_unlocking(spark):
    cells = spark.createDataFrame([("p", "ki", 0.9), ("p", "vi", 0.6), ("q", "m", 0.1)], "k string, marker string, share double")
    assert rows(slots.detected(cells, ["k"])) == {("p", 2, True), ("q", 0, False)}
    made = rows(slots.packet({"cells": cells, "residue": cells.filter("k = 'p'").select("k", "marker")}, ["k"]))
    assert ("q", '{"cells": [{"marker":"m","share":0.1}], "residue": []}') in made and len(made) == 2
    switches = spark.createDataFrame([("p", {"case": "true"}), ("q", {"case": "false"})], "key string, switches map<string,string>")
    order = slots.unlock([("case", "switch:case == true"), ("agreement", "paradigm:case in {done}"), ("tone", "switch:tone == true")], switches, {})
    assert order == {"p": ["case", "agreement"], "q": []}
