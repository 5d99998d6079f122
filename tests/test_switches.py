import pytest
from pyspark.sql import functions as F

from morphloom.operators import modes, switches


def words(spark, *items, n=2):
    return spark.createDataFrame([("p", w, n) for w in items], "k string, word string, n int")


def value(df):
    return [(r.value, r.confidence, r.support) for r in df.collect()]


def test_processes_need_several_stems(spark):
    bases = ["buku", "araw", "tala", "kita", "mano", "pelo", "ruta", "soma"]
    doubled = words(spark, *bases, *[b + "-" + b if i % 2 else b + b for i, b in enumerate(bases)], "beber", "xx-yy", "-")
    assert value(switches.reduplication(doubled, ["k"])) == [("true", 0.77, 8)]
    assert value(switches.reduplication(doubled.filter("word <> 'buku'"), ["k"])) == [("false", 0.73, 7)]
    infixed = words(spark, *bases, *[b[0] + "um" + b[1:] for b in bases], "lakini", "lini")
    assert value(switches.infixation(infixed, ["k"])) == [("true", 0.7, 8)]
    assert value(switches.infixation(words(spark, *bases), ["k"])) == [("false", 0.55, 0)]


def test_gender_and_noun_classes(spark):
    stems = ["gat", "perr", "niñ", "chic", "tí", "amig", "her", "hij"]
    none = spark.createDataFrame([], "k string, form string, kind string")
    both = words(spark, *[s + e for s in stems for e in "oa"])
    assert value(switches.gender_or_noun_class(both, none, ["k"])) == [("gender", 0.65, 8)]
    assert value(switches.gender_or_noun_class(words(spark, "gato"), none, ["k"])) == [("none", 0.55, 0)]
    roots = [f"roo{a}{b}" for a in "bdgklmnprs" for b in "eiu"]
    prefixes = spark.createDataFrame([("p", f, "prefix") for f in ("m", "wa", "ki", "vi", "long")], "k string, form string, kind string")
    assert value(switches.gender_or_noun_class(words(spark, *roots, *[p + r for p in ("m", "wa", "ki", "vi", "long") for r in roots]), prefixes, ["k"])) == [("noun-class", 0.7, 30)]
    assert switches.gender_or_noun_class(both.limit(0), prefixes, ["k"]).count() == 0


def test_sweep_compares_with_another_source(spark):
    affixes = spark.createDataFrame([("p", "suffix")] * 4 + [("p", "prefix")], "k string, kind string")
    found = switches.polarity(affixes, ["k"])
    index = spark.createDataFrame([("p", 2.5, 0.1, "agglutinative")], "k string, index double, clean double, type string")
    on = switches.alternations(spark.createDataFrame([("p", 0)], "k string, n int"), ["k"], "vowel_harmony")
    reported = spark.createDataFrame([("p", "affix_polarity", "suffixing"), ("p", "synthesis", "fusional")], "k string, switch string, reported string")
    got = {r.switch: (r.value, r.confidence, r.agrees) for r in switches.sweep([found, switches.synthesis_switch(index, ["k"]), on], reported, ["k"]).collect()}
    assert got == {"affix_polarity": ("suffixing", 0.99, True), "synthesis": ("agglutinative", 0.4, False), "vowel_harmony": ("false", 0.5, None)}
    assert switches.sweep([found], None, ["k"]).collect()[0].confidence == 0.9


def test_alternating_segments(spark):
    get = lambda a, b: spark.range(1).select(switches.alternating_segment(F.lit(a), F.lit(b)).alias("x")).collect()[0].x
    assert tuple(get("mu", "mw")) == (["u", "w"], True) and tuple(get("in", "im")) == (["m", "n"], False) and tuple(get("a", "a")) == ([], False)


def test_table_modes(spark):
    rows = [(1, "dog dogs", "mbwa wambwa"), (2, "dog", "mbwa"), (3, "dogs cats", "wambwa wapaka"), (4, "cat", "paka"), (5, "cats", "wapaka"), (6, "cat dog", "paka mbwa")]
    side = lambda i: spark.createDataFrame([("s", r[0], at, w) for r in rows for at, w in enumerate(r[i].split())], "space string, row int, at int, word string")
    source, target = side(1), side(2)
    best = lambda df: {(r.target, r.source) for r in df.filter("rank = 1").collect()}
    assert best(modes.build_table("identity", source, target)) == {("mbwa", "dog"), ("wambwa", "dogs"), ("paka", "cat"), ("wapaka", "cats")}
    assert {r.source for r in modes.build_table("guided", source, target).select("source").collect()} == {"dog", "cat", "s"}
    factors = spark.createDataFrame([("s", "wambwa", "WA"), ("s", "wapaka", "WA")], "space string, word string, factor string")
    assert {t for t, _ in best(modes.build_table("factored", source, target, factors))} == {"mbwa", "paka", "WA"}
    with pytest.raises(ValueError, match="unknown mode"):
        modes.build_table("bpe", source, target)
