from pyspark.sql import functions as F

from morphloom.operators import induce
from morphloom.plans import induction


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def words(spark, *items, n=2):
    return spark.createDataFrame([("p", w, n) for w in items], "k string, word string, n int")


def affixes(spark):
    return spark.createDataFrame([("p", "prefix", "ni"), ("p", "prefix", "a"), ("p", "suffix", "s"), ("p", "suffix", "ks"), ("p", "suffix", "")], "k string, side string, affix string")


def test_peel_takes_the_longest_edge_until_a_known_word_is_left(spark):
    known = words(spark, "walk", "wal")
    got = rows(induce.peel(words(spark, "walk", "niwalk", "walks", "niwalkss", "zzzz", "aniwalk"), known, affixes(spark), ["k"]), "word", "stem", "peeled", "known")
    assert got == {("walk", "walk", 0, True), ("niwalk", "walk", 1, True), ("walks", "wal", 1, True), ("niwalkss", "wal", 3, True), ("zzzz", "zzzz", 0, False), ("aniwalk", "walk", 2, True)}
    assert induce.peel(known.limit(0), known, affixes(spark), ["k"]).count() == 0


def test_peeling_reaches_the_depth_asked_for(spark, monkeypatch):
    many, known = words(spark, "aaaaaaawalk", "aaaawalk"), words(spark, "walk")
    deep = {None: {("aaaaaaawalk", "walk", 7, True), ("aaaawalk", "walk", 4, True)}, 5: {("aaaaaaawalk", "aawalk", 5, False), ("aaaawalk", "walk", 4, True)}}
    for depth, want in deep.items():
        assert rows(induce.peel(many, known, affixes(spark), ["k"], depth), "word", "stem", "peeled", "known") == want
    monkeypatch.setattr(induction.r, "vocabulary", lambda *_: many.withColumnRenamed("k", "pair"))
    monkeypatch.setattr(induction, "_known", lambda *_: known.withColumnRenamed("k", "pair"))
    monkeypatch.setattr(induction, "_edges", lambda *_: affixes(spark).withColumnRenamed("k", "pair"))
    assert rows(induction.peeled_words(spark, ""), "word", "peeled") == {("aaaaaaawalk", 5), ("aaaawalk", 4)}
    assert rows(induction.synthesis(spark, ""), "index", "type") == {(6.5, "polysynthetic")}
    assert rows(induction.unexplained_mass(spark, ""), "stacked") == {(0.5,)}


def test_synthesis_and_what_is_left(spark):
    vocabulary = words(spark, "walk", "niwalk", "zzzz", "papala")
    peeled = induce.peel(vocabulary, words(spark, "walk"), affixes(spark), ["k"])
    stripped = induce.strip_edges(vocabulary, affixes(spark), ["k"])
    assert rows(induce.synthesis(vocabulary, stripped, ["k"]), "index", "type") == {(1.25, "isolating")}
    assert rows(induce.unexplained(vocabulary, peeled, ["k"])) == {("p", 0.0, 0.25)}


def test_additive_words_and_new_roots(spark):
    vocabulary = words(spark, "niwalk", "niwalks", "nizuzu", "other")
    assert rows(induce.additive_words(vocabulary, words(spark, "walk"), affixes(spark), ["k"]), "word") == {("niwalk",), ("niwalks",)}
    roots = spark.createDataFrame([("p", "walk")], "k string, root string")
    got = rows(induce.grow_roots(vocabulary, roots, affixes(spark), ["k"]), "root", "n")
    assert ("zuzu", 2) in got and all(r != "walk" for r, _ in got)


def test_labels_and_splits(spark):
    glossed = spark.createDataFrame([("p", "kata", "cat"), ("p", "wakata", "cats"), ("p", "mbwa", "dog"), ("p", "wambwa", "dogs")], "k string, word string, gloss string")
    assert ("prefix", "wa", "PL", 2) in rows(induce.label_affixes(glossed, ["k"]), "side", "affix", "label", "n")
    best = spark.createDataFrame([("p", "walk", "tembea"), ("p", "walked", "li"), ("p", "talk", "sema"), ("p", "talked", "li"), ("p", "bed", "kitanda")], "k string, source string, target string")
    splits = induce.guided_splits(best, ["k"])
    assert rows(splits, "word", "base", "residue") == {("walked", "walk", "ed"), ("talked", "talk", "ed")}
    tokens = spark.createDataFrame([("p", 1, 0, "walked"), ("p", 1, 1, "bed")], "k string, row int, at int, word string")
    assert [r.word for r in induce.apply_splits(tokens, splits, ["k"]).orderBy("at", "part").collect()] == ["walk", "ed", "bed"]


def test_families(spark):
    families = spark.createDataFrame([("p", "ki ku", 2), ("p", "ka tta", 2), ("p", "li lo la", 3), ("p", "n nt", 2)], "k string, members string, forms bigint")
    assert rows(induce.archiphonemes(families, ["k"]), "pattern", "alternants") == {("kV", "iu"), ("lV", "aio")}
    assert rows(induce.enumeration_debt(families, ["k"])) == {("p", 4, 5)}


def test_cores_and_places(spark):
    assert rows(induce.shared_core(words(spark, "xkatay", "katab", "qkata", "zz"), ["k"]), "core", "words") == {("kata", 3)}
    prefixes = spark.createDataFrame([("p", "ni")], "k string, prefix string")
    assert rows(induce.place_histogram(words(spark, "nipata", "nikata", "niota"), prefixes, ["k"]), "place", "n") == {("labial", 2), ("dorsal", 2)}


def test_environments_split_a_morph(spark):
    source = spark.createDataFrame([("x", f"r{i}", 0, "one" if i % 2 else "two") for i in range(8)], "space string, row string, at int, word string")
    target = spark.createDataFrame([("x", f"r{i}", 0, "na", "v" if i % 2 else "c") for i in range(8)], "space string, row string, at int, word string, right_class string")
    got = rows(induce.split_by_environment(source, target, F.col("right_class") == "v", "na"), "side", "source", "prob")
    assert got == {("in", "one", 1.0), ("out", "two", 1.0)}


def test_rounds_stop_when_dry():
    yields = [3, 0, 1, 0, 0, 9]
    assert induce.until_dry(lambda i: yields[i]) == [3, 0, 1, 0, 0] and induce.until_dry(lambda i: 1, 3) == [1, 1, 1]


def test_cotraining_adds_only_roots_that_raise_coverage(spark):
    vocabulary = words(spark, "niwalk", "nizuzu", "zuzu", "qqq").select("k", "word", "n")
    roots = spark.createDataFrame([("p", "walk", "walk")], "k string, form string, gloss string")
    fixes = spark.createDataFrame([("p", "ni", "1SG", "prefix")], "k string, form string, gloss string, kind string")
    table = spark.createDataFrame([("p", "nizuzu", "sleep", 0.9, 5), ("p", "qqq", "dream", 0.1, 5)], "k string, target string, source string, prob double, n int")
    got, seen = induce.cotrain(vocabulary, roots, fixes, table, ["k"])
    assert seen == [0.25, 0.75] and {"walk", "zuzu"} <= {r.form for r in got.collect()} and "qqq" not in {r.form for r in got.collect()}


def test_cotraining_aligns_anew_and_is_guarded_in_each_key(spark):
    listed = [("p", w) for w in ("niwalk", "nizuzus", "qqq", "kkk")] + [("q", w) for w in ("walk", "zzz")]
    vocabulary = spark.createDataFrame([(k, w, 2) for k, w in listed], "k string, word string, n int")
    roots = spark.createDataFrame([("p", "walk", "walk"), *[("q", "walk", f"g{i}") for i in range(9)]], "k string, form string, gloss string")
    fixes = spark.createDataFrame([("p", "ni", "1SG", "prefix"), ("p", "s", "PL", "suffix")], "k string, form string, gloss string, kind string")

    def table(parses):
        known = {r.word for r in parses.collect()}
        sure = [("p", "nizuzus", "sleep")] if "nizuzus" not in known else [("p", "qqq", "dream")]
        return spark.createDataFrame([(*x, 0.9, 5) for x in [*sure, ("q", "zzz", "nap")]], "k string, target string, source string, prob double, n int")

    got, seen = induce.cotrain(vocabulary, roots, fixes, table, ["k"], most_readings=4.5)
    assert {tuple(r) for r in got.filter("form != 'walk'").collect()} == {("p", "zuzu", "sleep"), ("p", "qqq", "dream")}
    assert seen == [2 / 6, 3 / 6, 4 / 6]


def test_queries_run(spark, folder):
    for name in set(induction.QUERIES) - set(induction.SQL) - {"cotrained_roots"}:
        assert induction.QUERIES[name](spark, folder).count() >= 0, name
