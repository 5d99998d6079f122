"""Operators on hand-made rows whose results are known."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from morphloom.functions import text as fx
from morphloom.operators import align, assess, audio, bilingual, classes, detect, gates, gold, ledger, morph, paradigm, project, review, sequence, stats
from morphloom.plans import corpus, grammar

PARALLEL = [("r1", ["god", "love"], ["tanri", "sevgi"]), ("r2", ["god", "world"], ["tanri", "dunya"]), ("r3", ["love", "world"], ["sevgi", "dunya"])]


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def column(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).collect()[0][0]


@pytest.fixture(scope="module")
def sides(spark):
    df = spark.createDataFrame(PARALLEL, "row string, src array<string>, tgt array<string>").withColumn("space", F.lit("x"))
    make = lambda c: df.select("space", "row", F.posexplode(c).alias("at", "word"))
    return make("src"), make("tgt")


def test_alignment_finds_the_pairs(sides):
    scores = align.dice_scores(*sides, "space", "row", "word")
    assert rows(scores.filter("target = 'sevgi' and source = 'love'"), "n_both", "dice") == {(2, 1.0)}
    best = align.best_glosses(align.gloss_table(align.dice_links(*sides, scores)))
    assert rows(best, "target", "source", "prob") == {("sevgi", "love", 1.0), ("tanri", "god", 1.0), ("dunya", "world", 1.0)}
    assert align.sense_links(align.gloss_table(align.dice_links(*sides, scores))).count() == 3
    em = align.em_table(*sides, rounds=4)
    top = em.groupBy("target").agg(F.max_by("source", "prob").alias("s"))
    assert rows(top) == {("sevgi", "love"), ("tanri", "god"), ("dunya", "world")}


def test_a_repeated_word_counts_once_a_row_but_links_every_position(spark):
    one = spark.createDataFrame([("x", "r", 0, "a"), ("x", "r", 1, "a")], "space string, row string, at int, word string")
    two = spark.createDataFrame([("x", "r", 0, "b"), ("x", "r", 1, "b"), ("x", "r", 2, None)], "space string, row string, at int, word string")
    scores = align.dice_scores(one, two, "space", "row", "word")
    assert rows(scores, "n_both", "dice") == {(1, 1.0)}
    links = align.dice_links(one, two.dropna(), scores)
    assert rows(links, "target_at", "source_at") == {(0, 0), (1, 0)}


def test_text_functions(spark):
    get = lambda e: column(spark, e, w="papaya", n="1,234.5", g="house; home (big)", t="<think>A</think> Answer: C or D")
    assert get(fx.reduplicated(F.col("w"))) == "pa" and get(fx.token_class(F.col("n"))) == "number" and get(fx.gloss_slug(F.col("g"))) == "house"
    assert get(fx.answer_letter(F.col("t"))) == "C" and get(fx.common_prefix(F.col("w"), F.lit("papa"))) == 4 and get(fx.vowel_groups(F.col("w"))) == 3
    assert get(fx.canonical_key(fx.feature_map(F.lit("b=2;a=1;b=3")))) == "a=1;b=3"
    assert get(fx.nfc(F.lit("é"))) == "é" and get(fx.is_grammatical(F.lit("1SG"))) and not get(fx.is_grammatical(F.lit("3")))
    assert get(fx.tokens(F.lit("Ñandú x_1!"))) == ["ñandú", "x_1"] and get(fx.is_leipzig(F.lit("AOR.3"))) and not get(fx.is_word(F.lit("a--b")))


def test_statistics(spark):
    votes = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("k", None), ("j", "z")], "k string, v string")
    assert rows(stats.modal(votes, ["k"], "v"), "k", "v", "n", "share") == {("k", "a", 2, 0.5), ("j", "z", 1, 1.0)}
    counts = spark.createDataFrame([("k", "a", "l", 2), ("k", "b", "r", 2)], "k string, label string, side string, n int")
    assert rows(stats.entropy(counts, ["k"], "n")) == {("k", 1.0)}
    assert rows(stats.information_gain(counts, ["k"], "label", "side", "n")) == {("k", 1.0)}
    pairs = spark.createDataFrame([("k", 1, 10), ("k", 2, 20), ("k", 2, 20), ("k", 3, 5)], "k string, x int, y int")
    rho = stats.spearman(pairs, ["k"], "x", "y").collect()[0].rho
    assert abs(rho + 1 / 3) < 1e-9
    assert column(spark, stats.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))), x=1) == 0
    assert column(spark, stats.cosine(F.array().cast("array<double>"), F.array(F.lit(2.0))), x=1) is None


def test_lift_prefers_rounded_lift_then_support(spark):
    data = [("s", "Plur")] * 10 + [("s", None)] * 2 + [("x", "Sing")] * 30
    df = spark.createDataFrame(data, "affix string, feature string")
    got = stats.lift(df, "affix", "feature", df).collect()
    assert [(r.affix, r.feature, r.n, r.n_item) for r in got] == [("s", "Plur", 10, 12)]


def test_sequences(spark):
    df = spark.createDataFrame([("r", 0, "a"), ("r", 1, "9"), ("r", 2, "b"), ("r", 3, "c")], "row string, at int, word string")
    kept = sequence.neighbours(df, ["row"], "at", "word", F.col("word") != "9")
    assert rows(kept, "word", "before", "after") == {("a", "<s>", "b"), ("b", "a", "c"), ("c", "b", None)}
    gaps = sequence.boundary_gaps(spark.createDataFrame([("r", 0.0, 1.0), ("r", 1.2, 2.0), ("r", 4.0, 5.0)], "row string, s double, e double"), ["row"], "s", "e")
    assert [round(r.gap, 3) for r in gaps.orderBy("s").collect()] == [0.2, 0.5, 0.5]


def test_parser_reads_prefix_root_suffix(spark):
    words = spark.createDataFrame([("x", "niwalk"), ("x", "walks"), ("x", "ghost"), ("x", ""), ("x", None), ("x", "walk" + "s" * 40)], "pair string, word string")
    roots = spark.createDataFrame([("x", "walk", "walk"), ("x", "wal", "wall"), ("y", "ghost", "ghost")], "space string, form string, gloss string")
    fixes = spark.createDataFrame([("x", "ni", "1SG", "prefix"), ("x", "s", "PL", "suffix"), ("x", "ks", "KS", "suffix")], "space string, form string, gloss string, kind string")
    got = rows(morph.parse_words(words, "pair", "word", roots, fixes), "word", "line", "forms")
    assert got == {("niwalk", "1SG-walk", "ni-walk"), ("walks", "walk-PL", "walk-s"), ("walks", "wall-KS", "wal-ks")}


def test_parser_equals_exhaustive_search():
    roots, pre, suf = {"a": ["A"], "ab": ["AB"], "b": ["B"]}, {"a": ["p"], "b": ["q"]}, {"b": ["s"], "a": ["t"]}

    def brute(word):
        out = set()
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                for root in roots.get(word[i:j], ()):
                    split = lambda text, table: ([()] if not text else []) + [((text[:k], g), *rest) for k in range(1, len(text) + 1) for g in table.get(text[:k], ()) for rest in split(text[k:], table)]
                    for front in split(word[:i], pre):
                        for back in split(word[j:], suf):
                            if max(len(front), len(back)) <= 4 and len(set(front)) == len(front) and len(set(back)) == len(back):
                                out.add((*front, (word[i:j], root), *back))
        return out

    for word in ("a", "ab", "aab", "baab", "abab", "bbaab"):
        assert morph.analyses_of(word, roots, pre, suf) == brute(word)


def test_merges(spark):
    words = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, n int")
    merges = morph.learn_merges(words, 4)
    assert merges[:3] == [("e", "s"), ("es", "t"), ("est", "▁")]
    assert column(spark, morph.apply_merges(F.lit("lowest"), merges), x=1)[-1].endswith("est")


def test_merges_are_learned_from_each_key_alone(spark):
    words = {"p": {"low": 5, "lower": 2, "newest": 6, "widest": 3, "aaaa": 2, "once": 1, "": 4}, "q": {"banana": 3, "bandana": 2, "nab": 1}}
    df = spark.createDataFrame([(k, w, n) for k, v in words.items() for w, n in v.items()], "k string, word string, n int")
    for most in (4, 300):
        want = set()
        for k in words:
            one = df.filter(F.col("k") == k)
            merges = morph.learn_merges(one.select("word", "n"), most)
            want |= {(k, r.word, tuple(r.s)) for r in one.select("word", morph.apply_merges(F.col("word"), merges).alias("s")).collect()}
        assert {(r.k, r.word, tuple(r.symbols)) for r in morph.merged_words(df, ["k"], most).collect()} == want


def test_bpe_query_learns_past_a_dozen_merges(spark, folder):
    joined = grammar.bpe_merges(spark, folder).select("pair", F.explode(F.split("symbols", " ")).alias("s")).filter("length(s) > 1").groupBy("pair").agg(F.count_distinct("s").alias("n"))
    assert joined.agg(F.max("n")).collect()[0][0] > 12


def test_near_forms_equal_all_pairs(spark):
    import itertools
    import random

    draw = random.Random(4)
    forms = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(120)})

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    df = spark.createDataFrame([("p", f) for f in forms] + [("p", None), ("p", "")], "pair string, form string")
    assert rows(morph.near_forms(df, ["pair"]), "left", "right") == {(a, b) for a, b in itertools.combinations(forms, 2) if distance(a, b) == 1}


def test_assessment_on_the_reference_rows(spark):
    parses = spark.createDataFrame([("k", "a", 1, "x"), ("k", "c", 1, "y"), ("k", "c", 2, "z")], "k string, word string, analysis int, line string")
    words = spark.createDataFrame([("k", "a", 2), ("k", "b", 5), ("k", "c", 1)], "k string, word string, n int")
    c = assess.coverage(words, parses, ["k"]).collect()[0]
    assert (c.type_coverage, c.token_coverage) == (2 / 3, 3 / 8)
    a = assess.ambiguity(parses, ["k"]).collect()[0]
    assert (a["mean"], a.rate) == (1.5, 0.5) and abs(a.geometric_mean - math.sqrt(2)) < 1e-12
    gold_rows = spark.createDataFrame([("k", "a", "x"), ("k", "c", "q")], "k string, word string, line string")
    assert rows(assess.roundtrip(parses, gold_rows, ["k"])) == {("k", 2, 1, 0.5)}
    assert rows(assess.overgeneration(parses, gold_rows, ["k"]), "readings", "spurious") == {(3, 2)}
    assert rows(assess.non_regression(parses, parses.filter("word = 'c'"), gold_rows, ["k"])) == {("k", 1, 0)}
    assert column(spark, assess.tolerance(F.lit(100), F.lit(21)), x=1) and not column(spark, assess.tolerance(F.lit(100), F.lit(22)), x=1)
    assert column(spark, assess.tolerance(F.lit(1), F.lit(0)), x=1) is None


def test_gold_functions(spark):
    gloss = "first-person singular present indicative of «ir»"
    get = lambda e: column(spark, e, g="third-person plural past of hablar", s=1)
    assert get(gold.form_of_lemma(F.col("g"))) == "hablar" and get(gold.form_of_features(F.col("g"))) == {"Person": "3", "Number": "Plur", "Tense": "Past"}
    assert get(gold.is_form_of(F.lit(gloss))) and not get(gold.is_form_of(F.lit("a house")))
    assert get(gold.real_senses(F.array(F.lit("plural of x"), F.lit("abbreviation of y"), F.lit("house")))) == ["house", "abbreviation of y"]
    assert get(gold.english_inflection(F.lit("try"), F.lit("tries"))) == "PL" and get(gold.english_inflection(F.lit("make"), F.lit("making"))) == "PROG"
    edit = get(gold.inflection_edit(F.lit("hablar"), F.lit("hablo")))
    assert tuple(edit) == ("suffix", "ar", "o") and tuple(get(gold.inflection_edit(F.lit("toto"), F.lit("mtoto")))) == ("prefix", "", "m")
    assert get(gold.pos_from_upos(F.lit("PROPN"))) == "Proper noun" and get(gold.pos_from_upos(F.lit("Weird"))) == get(gold.pos_from_cycle(F.lit(None).cast("string"))) == "Unknown"
    assert get(gold.pos_from_cycle(F.lit("ptcl"))) == "Particle" and get(gold.pos_from_dictionary(F.lit("Article"))) == "Determiner" and get(gold.inflection_features(F.lit("V;IND;PST; 1;SG;PL;X"))) == {"Mood": "Indicative", "Tense": "Past", "Person": "First", "Number": "Plural"}


def test_classes(spark):
    votes = spark.createDataFrame([("p", "c1", "Ø", 30), ("p", "c1", "wa", 40), ("p", "c2", "ki", 5)], "k string, noun_class string, marker string, n int")
    assert rows(classes.concord(votes, ["k"]), "noun_class", "marker") == {("c1", "wa")}
    genders = spark.createDataFrame([("p", "mano", 0, 10), ("p", "libro", 3, 0), ("p", "x", 0, 0)], "k string, noun string, m int, f int")
    assert rows(classes.gender_classes(genders, ["k"])) == {("p", "mano", "F", 1.0, True), ("p", "libro", "M", 0.6, False)}
    words = [f"{p}{s}" for s in ("toto", "tuku", "sana", "keka", "limu") for p in ("m", "wa")] + [f"{p}{s}" for s in ("tabu", "tasa", "baro", "beli") for p in ("ki", "vi")]
    vocabulary = spark.createDataFrame([("p", w) for w in words], "k string, word string")
    prefixes = spark.createDataFrame([("p", x) for x in ("m", "wa", "ki", "vi", "k")], "k string, prefix string")
    assert rows(classes.class_pairs(vocabulary, prefixes, ["k"]), "singular", "plural", "shared") == {("m", "wa", 5), ("ki", "vi", 4)}
    low, high = (spark.createDataFrame([("n", v)], "noun string, c string") for v in ("a", "b"))
    assert rows(classes.by_priority([low, high], ["noun"], "c")) == {("n", "b")}
    nouns = spark.createDataFrame([("p", w) for w in ("casa", "masa", "tasa", "amor", "alma", "arte", "sol")], "k string, noun string")
    carved = rows(classes.carve(nouns, ["k"]), "environment", "noun")
    assert {n for e, n in carved if e == "-asa"[0:4]} == {"casa", "masa", "tasa"} and {n for e, n in carved if e == "a-"} == {"amor", "alma", "arte"}


def test_carving_goes_on_until_no_environment_is_left(spark):
    words = [f"{x}{c}{v}" for c in "bcdfghjklmnprstvwxyz" for v in "eiou" for x in ("mu", "ni", "to", "be")] + ["alba", "zq"]
    left, want = {w: [*["a-"] * w.startswith("a"), f"-{w[-3:]}"[: len(w) * 2], f"-{w[-2:]}"] for w in words}, set()
    while left:
        n = Counter(e for envs in left.values() for e in set(envs))
        best = min(n, key=lambda e: (-n[e], e))
        if n[best] < 3:
            break
        want |= {("p", best, w) for w, envs in left.items() if best in envs}
        left = {w: envs for w, envs in left.items() if best not in envs}
    assert len({e for _, e, _ in want}) == 80
    assert rows(classes.carve(spark.createDataFrame([("p", w) for w in words], "k string, noun string"), ["k"])) == want


def test_open_residues_have_infixes_and_leave_out_known_affixes(spark):
    words = spark.createDataFrame([("p", w, 2) for w in ("sumulat", "sulatan", "nasulat", "sxulat", "akbkat", "sulatin")], "k string, word string, n int")
    roots = spark.createDataFrame([("p", x) for x in ("sulat", "lat", "akat")], "k string, root string")
    known = spark.createDataFrame([("p", "suffix", "in")], "k string, side string, residue string")
    assert rows(morph.open_residues(words, roots, known, ["k"])) == {("p", "infix", "um", 2), ("p", "suffix", "an", 2), ("p", "prefix", "na", 2)}


def test_em_gloss_has_five_rounds(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(align, "em_table", lambda source, target, rounds=5: asked.append(rounds))
    corpus.em_gloss(spark, folder)
    assert asked == [5]


def test_projection(spark):
    pivot = spark.createDataFrame([("v", 0, "Dogs", "NOUN", "nsubj", 1, {"Number": "Plur"}), ("v", 1, "eat", "VERB", "ROOT", 1, {"Tense": "Past"}), ("v", 2, "Rome", "PROPN", "obj", 1, {}), ("v", 3, "fish", "NOUN", "obj", 1, {})], "row string, i int, text string, pos string, dep string, head int, feats map<string,string>")
    target = spark.createDataFrame([("v", 0, "mbwa"), ("v", 1, "walila"), ("v", 2, "samaki"), ("v", 3, "roma")], "row string, at int, word string")
    best = spark.createDataFrame([("mbwa", "dogs"), ("walila", "eat"), ("samaki", "fish"), ("roma", "rome")], "word string, source string")
    got = project.project(pivot, target, best)
    assert rows(got, "word", "role", "head_word") == {("mbwa", "nsubj", "walila"), ("walila", "ROOT", "walila"), ("samaki", "obj", "walila")}
    assert rows(project.word_order(got)) == {("SVO", 1)} and rows(project.subject_verbs(got), "noun", "verb") == {("mbwa", "walila")}
    assert rows(project.tense_slots(got, ["wa"], 1), "slot", "tense") == {("li", "Past")}
    assert project.derive_pos(got).count() == 0 and project.derive_pos(got, 1).count() == 3
    assert project.role_suffixes(got, stems=1).count() > 0 and project.negation(got, pivot, 1, 0.1).count() == 0
    assert rows(project.determiner_votes(got, 1), "before") == {("<s>",), ("walila",)}


def test_bilingual(spark):
    source = spark.createDataFrame([(1, 0, "Dog", ["n", "pl"]), (1, 1, "run", ["v"]), (1, 2, "zzz", [])], "s int, at int, lemma string, tags array<string>")
    target = spark.createDataFrame([(1, 0, "mbwa", ["n", "sg"]), (1, 0, "mbwa", ["n"])], "s int, at int, lemma string, tags array<string>")
    dictionary = spark.createDataFrame([("dog", "mbwa"), ("run", "kimbia"), ("dog", "mbwa")], "reference string, vernacular string")
    assert rows(bilingual.find_references(source, target, dictionary, ["s"])) == {(1, 0, 0, "dog", "mbwa")}
    assert rows(bilingual.translation_flags(source, target, dictionary, ["s"])) == {(1, 1, "missing", 0.6), (1, 0, "number", 0.7)}
    walk = F.create_map(F.lit("Plur"), F.lit("pl"), F.lit("Noun"), F.lit("n"))
    assert tuple(column(spark, bilingual.map_tags(F.array(F.lit("Noun"), F.lit("X")), walk), x=1)) == (["n"], ["X"])
    assert column(spark, bilingual.invert(walk), x=1) == {"pl": "Plur", "n": "Noun"}
    changes = spark.createDataFrame([("bilingual.sense_link.add", {"reference_lemma": '{"lang":"eng","lemma":"a"}', "vernacular_sense": '{"entry":"b"}'}), ("bilingual.sense_link.add", {"reference_lemma": "a", "vernacular_sense": "b"}), ("bilingual.sense_link.add", {"reference_lemma": "a"}), ("x", {})], "op string, fields map<string,string>")
    assert rows(bilingual.links_from_changes(changes)) == {("a", "", "b", "")}


def test_audio(spark):
    words = spark.createDataFrame([("f", "Mtoto", 0.0, 0.5, 0.9), ("f", "watoto", 0.6, 1.0, 0.8), ("f", "totoni", 1.0, 1.4, 0.7)], "source_id string, word string, start double, end double, probability double")
    samples = spark.createDataFrame([("mtoto", ["toto", ""])], "sample string, stems array<string>")
    got = audio.occurrences(samples, words).orderBy("place").collect()
    assert [(r.word, r.match) for r in got] == [("Mtoto", "exact"), ("totoni", "stem")] and got[0].right == ["watoto", "totoni"]
    evidence = spark.createDataFrame([("kata", ["k", "a"]), ("cata", ["k", "a"]), ("x", ["x"]), ("y", [])], "word string, phones array<string>")
    assert rows(audio.spelling_alerts(evidence)) == {("k a", 2, "cata kata")}
    assert column(spark, audio.feature_mismatches(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d"))), x=1) == 2
    assert column(spark, audio.anchor_covers(F.lit("MAT 1"), F.lit("MAT 1:3")), x=1) and not column(spark, audio.anchor_covers(F.lit("MAT 1"), F.lit("MAT 12")), x=1)
    seen = spark.createDataFrame([("n", True), ("n", True), ("m", False), ("m", False), ("o", True)], "member string, has_feature boolean")
    assert rows(audio.conditioning(seen), "member", "verdict") == {("n", "confirmed"), ("m", "conflict"), ("o", "insufficient")}


def test_paradigms(spark):
    profiles = spark.createDataFrame([("p", "an", "right", "V", 10), ("p", "a", "right", "C", 10), ("p", "a", "right", "#", 90)], "k string, form string, dimension string, bucket string, n int")
    features = spark.createDataFrame([("p", "an", "Def=Ind"), ("p", "a", "Def=Ind")], "k string, form string, feature string")
    forms = spark.createDataFrame([("p", "a"), ("p", "an"), ("p", "zzz")], "k string, form string")
    assert rows(paradigm.allomorphs(forms, profiles, features, ["k"]), "left", "right", "meaning", "dimension", "score") == {("a", "an", 1.0, "right", 1.0)}
    results = spark.createDataFrame([("m", "e1", 0.5, 0.9, 9), ("m", "e2", 0.4, 0.1, 9), ("m", "e3", 0.4, 0.1, 5), ("m", "e4", 0.1, 0.1, 9)], "k string, label string, gain double, host_share double, hosts int")
    assert rows(paradigm.best_environment(results, ["k"]), "label") == {("e3",)}
    cells = spark.createDataFrame([("k", "-ni", True), ("k", "wa-", True), ("k", "NI", False), ("k", "xx", False)], "k string, marker string, golden boolean")
    packet = spark.createDataFrame([("k", "ni"), ("k", "wa")], "k string, marker string")
    assert rows(paradigm.report_score(cells, packet, ["k"]), "completeness", "faithfulness", "overall") == {(0.5, 0.5, 0.25)}
    probes = spark.createDataFrame([("p", "a", 0.9, True, True), ("p", "b", 0.6, False, True), ("p", "c", 1.0, False, False)], "k string, probe string, unexplained double, proxy boolean, ready boolean")
    assert rows(paradigm.frontier(probes, ["k"]), "probe", "place", "next") == {("b", 1, True), ("a", 2, False)}
    assert column(spark, paradigm.rotate_options(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 4), x=1) == ["b", "c", "a"]
    parses = spark.createDataFrame([("p", "h1", "w", "x"), ("p", "h2", "w", "y"), ("p", "h1", "v", "x"), ("p", "h2", "v", "x")], "k string, hypothesis string, word string, line string")
    assert rows(paradigm.discriminating(parses, ["k"])) == {("p", "w")}


def test_gates_and_environments(spark):
    df = spark.createDataFrame([({"case": "true", "order": "suffixing"}, {"nc": "done"})], "switches map<string,string>, statuses map<string,string>")
    opened = lambda g: df.select(gates.gate(g)).collect()[0][0]
    assert opened("") and opened("switch:case == true and paradigm:nc in {done}") and opened("switch:no == x or switch:order ~ suffix")
    assert not opened("switch:case != true") and opened("switch:unknown != true") and not opened("paradigm:nc in {open, review}")
    with pytest.raises(ValueError):
        gates.gate("nonsense")
    env = spark.createDataFrame([("a", "vowel"), (None, None)], "right string, right_class string")
    assert [r[0] for r in env.select(gates.environment({"right_in": ["a"]})).collect()] == [True, False]


OPS = "op string, key string, confidence double, source string, at int, gloss string"
DECISIONS = "op string, key string, decision string, by string, at int"


def ledger_rows(df, *columns):
    return {r.key: tuple(r[c] for c in columns) for r in df.collect()}


def test_ledger_merges_by_signature(spark):
    ops = spark.createDataFrame([("a", "k", 0.4, "s1", 1, None), ("a", "k", 0.9, "s2", 2, "g2"), ("a", "k", 0.7, "s2", 3, "g3"), ("a", "one", None, None, 4, ""), ("a", "two", None, "", 5, None), ("a", "two", None, "s", 6, None)], OPS)
    merged = ledger.merge_changes(ops, "at", ["gloss"])
    assert ledger_rows(merged, "confidence", "rounds_seen", "status", "locked", "provenance", "gloss") == {
        "k": (0.9, 3, "deferred", False, ["s1", "s2", "s2"], "g2"), "one": (None, 1, "deferred", False, [], None), "two": (0.0, 2, "deferred", False, ["s"], None),
    }
    assert ledger.merge_changes(ops.limit(0), "at", ["gloss"]).count() == 0


def test_routing_by_confidence(spark):
    ops = spark.createDataFrame([("a", k, c, None, i, None) for i, (k, c) in enumerate([("a", 0.9), ("b", 0.6), ("c", 0.2), ("d", None)])], OPS)
    routed = ledger.route(ledger.merge_changes(ops, "at", ["gloss"]), 0.85, 0.5)
    assert {k: v[0] for k, v in ledger_rows(routed, "status").items()} == {"a": "accepted", "b": "review", "c": "deferred", "d": "deferred"}
    assert rows(ledger.route_tally(routed)) == {("accepted", 1), ("review", 1), ("deferred", 2)}
    assert [r.key for r in ledger.by_status(routed, "deferred").collect()] == ["c", "d"]


def test_a_decision_locks_a_row_against_routing_and_later_changes(spark):
    ops = spark.createDataFrame([("a", "z", 0.2, "s1", 1, None), ("a", "r", 0.9, None, 2, "g")], OPS)
    decided = ledger.decide(ledger.merge_changes(ops, "at", ["gloss"]), spark.createDataFrame([("a", "z", "accept", "human", 1), ("a", "r", "accept", "x", 1), ("a", "r", "reject", "y", 2), ("a", "unknown", "accept", "human", 3)], DECISIONS), "at")
    routed = ledger.route(decided)
    assert ledger_rows(routed, "status", "locked", "decided_by") == {"z": ("accepted", True, "human"), "r": ("rejected", True, "y")}
    assert rows(ledger.route_tally(routed)) == {("locked", 2)}
    later = spark.createDataFrame([("a", "z", 0.25, "s2", 9, "late"), ("a", "new", 0.6, None, 10, None)], OPS)
    again = ledger.merge_changes(later, "at", ["gloss"], state=routed)
    assert ledger_rows(again, "confidence", "rounds_seen", "status", "locked", "provenance", "gloss") == {
        "z": (0.2, 2, "accepted", True, ["s1", "s2"], None), "r": (0.9, 1, "rejected", True, [], "g"), "new": (0.6, 1, "deferred", False, [], None),
    }
    assert rows(ledger.summary(again)) == {("status", "accepted", 1), ("status", "rejected", 1), ("status", "deferred", 1), ("family", "a", 3), ("locked", "true", 2), ("locked", "false", 1)}


def test_decisions_in_between_equal_those_step_by_step(spark):
    events = [("a", f"k{i % 3}", (i * 7 % 10) / 10, f"s{i}", 2 * i, None if i % 4 else f"g{i}") for i in range(30)]
    choices = [("a", "k1", "accept", "human", 21), ("a", "k1", "reject", "h2", 45), ("a", "k2", "accept", "early", -1), ("a", "none", "accept", "human", 5)]
    ops, decisions = spark.createDataFrame(events, OPS), spark.createDataFrame(choices, DECISIONS)
    whole = ledger.merge_changes(ops, "at", ["gloss"], decisions=decisions)
    parts = None
    for low, high in ((-5, 20), (20, 44), (44, 99)):
        inside = lambda df: df.filter((F.col("at") >= low) & (F.col("at") < high))  # noqa: E731, B023
        parts = ledger.merge_changes(inside(ops), "at", ["gloss"], state=parts, decisions=inside(decisions))
    columns = ("confidence", "rounds_seen", "status", "locked", "decided_by", "provenance", "gloss")
    assert ledger_rows(whole, *columns) == ledger_rows(parts, *columns)
    assert ledger_rows(whole, "status", "locked", "decided_by") == {"k0": ("deferred", False, None), "k1": ("rejected", True, "h2"), "k2": ("deferred", False, None)}


def test_streamed_ledger_locks_too(spark, tmp_path):
    from morphloom.streaming import ledger as stream

    schema = "op string, key string, ordinal bigint, confidence double, source string, decision string, by string, gloss string"
    first = [("a", "z", 1, 0.2, "s1", None, None, ""), ("a", "z", 2, None, None, "accept", "human", None), ("a", "n", 3, None, None, "accept", "x", None)]
    second = [("a", "z", 4, 0.9, "s2", None, None, "late"), ("a", "n", 5, 0.6, None, None, None, "g")]
    for i, events in enumerate((first, second)):
        spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.to_table(stream.ledger_stream(source), "locked_ledger")
    got = ledger_rows(stream.newest(spark.table("locked_ledger")), "confidence", "rounds_seen", "status", "locked", "provenance", "gloss")
    assert got == {"z": (0.2, 2, "accepted", True, ["s1", "s2"], None), "n": (0.6, 1, "review", False, [], "g")}


def test_accepted_changes_are_valid(spark):
    ops = spark.createDataFrame([("lexical.sense.create", "e", 0.9, None, 1, "g"), ("lexical.sense.create", "f", 0.2, None, 2, None)], OPS)
    routed = ledger.route(ledger.merge_changes(ops, "at", ["gloss"]))
    fields = F.create_map(F.lit("entry"), F.col("key"), F.lit("gloss"), F.coalesce("gloss", F.lit("")))
    kept = ledger.accepted_changes(routed, fields)
    assert [(r.key, r.gloss) for r in kept.collect()] == [("e", "g")] and not {"status", "locked", "rounds_seen", "decided_by"} & set(kept.columns)
    with pytest.raises(Exception, match="accepted change is invalid: missing field: gloss"):
        ledger.accepted_changes(routed.withColumn("status", F.lit("accepted")), fields).collect()


def test_change_texts(spark):
    good = '{"op": "lexical.entry.create", "lexeme_form": {"seh": "kufamba"}, "morph_type": "stem", "confidence": 0.7}'
    texts = [f'{{"ops": [{good}]}}', f"```json\n[{good}]\n```", "no json", '{"x": 1}', '[{"op": "lexical.entry.create", "lexeme_form": {}, "morph_type": "stem"}]', '[{"op": "nope"}]', f'[{good.replace("0.7", "1.5")}]', f'[{good.replace("0.7", chr(34) + "x" + chr(34))}]', "[]"]
    found = ledger.changes_of(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), ["id"], F.col("t")).withColumn("key", ledger.key_of(F.col("op"), F.col("fields")))
    assert {(r.id, r.op, r.key, r.reason) for r in found.collect()} == {
        (0, "lexical.entry.create", "seh=kufamba", None), (1, "lexical.entry.create", "seh=kufamba", None), (2, None, "", "no list of changes"), (3, None, "", "no list of changes"),
        (4, "lexical.entry.create", "", "missing field: lexeme_form"), (5, "nope", "", "unknown op: nope"), (6, "lexical.entry.create", "seh=kufamba", "confidence out of range"), (7, "lexical.entry.create", "seh=kufamba", "confidence out of range"),
    }


def test_upsert_and_validation(spark):
    state = spark.createDataFrame([("k", "old", "x"), ("j", "keep", None)], "key string, gloss string, pos string")
    new = spark.createDataFrame([("k", "new", None), ("n", "add", "v")], "key string, gloss string, pos string")
    assert rows(ledger.upsert(state, new, ["key"], ["gloss", "pos"])) == {("k", "new", "x"), ("j", "keep", None), ("n", "add", "v")}
    checked = spark.createDataFrame([("lexical.sense.create", {"entry": "e", "gloss": "g"}, 0.5), ("lexical.sense.create", {"entry": "e"}, 0.5), ("nope", {}, 0.5), ("lexical.entry.set_pos", {"entry": "a", "pos": "b"}, 2.0)], "op string, fields map<string,string>, confidence double")
    assert [r.reason for r in ledger.validate(checked).collect()] == [None, "missing field: gloss", "unknown op: nope", "confidence out of range"]
    assert column(spark, ledger.map_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), x=1) == "a=1;b=2"


def test_review_and_detectors(spark):
    steps = spark.createDataFrame([("t", 0, "open", "in_review"), ("t", 1, "in_review", "resolved"), ("u", 0, "open", "in_review"), ("u", 1, "open", "open")], "id string, at int, from_status string, to_status string")
    assert rows(review.check_steps(steps)) == {("t", 2, 0), ("u", 2, 1)}
    assert column(spark, review.signals_concur(F.lit("high"), F.lit("Dog"), F.lit("big dog")), x=1) and not column(spark, review.signals_concur(F.lit("high"), F.lit(None).cast("string"), F.lit("dog")), x=1)
    affixes = spark.createDataFrame([("p", "a", "prefix"), ("p", "b", "suffix"), ("p", "c", "suffix")], "k string, form string, kind string")
    assert rows(detect.affix_polarity(affixes, ["k"]), "polarity") == {("suffixing",)}


def test_streamed_windows_equal_batch(spark, folder):
    from morphloom.streaming import ledger as stream

    events = spark.read.parquet(f"{folder}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    query = stream.to_table(stream.windowed_counts(source), "windows", "append")
    assert query.exception() is None
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count()
    assert 0 < spark.table("windows").count() <= batch.count()
