from pyspark.sql import functions as F

from morphloom.sources import readers, writers


def lines(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_numbered_lines_and_parallel_rows(spark, tmp_path):
    refs = readers.numbered_lines(spark, lines(tmp_path / "r.txt", "GEN 1:1\nMAT 1:1\nMAT 1:2\nMAT 1:3\n"))
    src = readers.numbered_lines(spark, lines(tmp_path / "s.txt", "In the Beginning\r\nGod Love\n\nx"))
    tgt = readers.numbered_lines(spark, lines(tmp_path / "t.txt", "mwanzo\nTanrı sevgi\nyok\n<range>\nmore"))
    assert [r.line_no for r in refs.orderBy("line_no").collect()] == [1, 2, 3, 4]
    got = {(r.ref, tuple(r.src), tuple(r.tgt)) for r in readers.parallel_lines(refs, src, tgt).collect()}
    assert got == {("GEN 1:1", ("in", "the", "beginning"), ("mwanzo",)), ("MAT 1:1", ("god", "love"), ("tanrı", "sevgi"))}


def test_tables(spark, tmp_path):
    glosses = readers.gloss_tsv(spark, lines(tmp_path / "g.tsv", "target\tsource\tprob\tcount\nsevgi\tlove\t0.5\t3\nx\ty\tbad\t\n"))
    assert {tuple(r) for r in glosses.collect()} == {("sevgi", "love", 0.5, 3), ("x", "y", None, None)}
    forms = readers.paradigms_tsv(spark, lines(tmp_path / "u.tsv", "Ir\tVoy\tV;1;SG\nbad line\n"))
    assert [tuple(r) for r in forms.collect()] == [("ir", "voy", "V;1;SG")]
    bank = readers.treebank(spark, lines(tmp_path / "x.conllu", "# c\n1-2\tdel\t_\t_\n1\tDe\tde\tADP\t_\n1.1\te\te\tX\t_\n\n"))
    assert [tuple(r) for r in bank.collect()] == [("de", "de", "ADP")]
    rows = readers.json_lines(spark, lines(tmp_path / "c.jsonl", '{"op": "a", "confidence": 0.5}\nnot json\n{"op": "b", "extra": 1}\n'), readers.CHANGE)
    assert sorted(r.op for r in rows.collect()) == ["a", "b"]


def test_dictionary_round_trip(spark, tmp_path):
    rows = [("love & co", ["n", "sg"], "sevgi", ["n"]), ("a<b", [], "c", [])]
    df = spark.createDataFrame(rows, "l string, lt array<string>, r string, rt array<string>")
    out = str(tmp_path / "bidix")
    writers.write_entries(df.coalesce(1), writers.bilingual_entry(F.col("l"), F.col("lt"), F.col("r"), F.col("rt")), out)
    got = {(r.reference, tuple(r.reference_tags), r.vernacular, tuple(r.vernacular_tags)) for r in readers.bilingual_xml(spark, out).collect()}
    assert got == {("love & co", ("n", "sg"), "sevgi", ("n",)), ("a<b", (), "c", ())}


def test_stream_round_trip(spark):
    text = "^cats/cat<n><pl>/cats<np>$ ^x/*x$"
    tokens = readers.token_stream(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"])
    got = [(r.at, r.surface, r.analysis, r.lemma, r.tags) for r in tokens.orderBy("at", "analysis").collect()]
    assert got == [(0, "cats", 0, "cat", ["n", "pl"]), (0, "cats", 1, "cats", ["np"]), (1, "x", 0, "*x", [])]
    back = tokens.groupBy("at").agg(F.first("surface").alias("s"), F.array_sort(F.collect_list(F.struct("lemma", "tags"))).alias("r")).select(writers.stream_token(F.col("s"), F.col("r")))
    assert sorted(r[0] for r in back.collect()) == ["^cats/cat<n><pl>/cats<np>$", "^x/*x$"]


def test_question_blocks(spark, tmp_path):
    text = "Question 1: Which?\nA one\nB two\nCorrect Answer: B\n\nQuestion 2: cut off\nA x\n\nQuestion 3: Who?\nCorrect Answer: (A)\n"
    got = readers.question_blocks(spark, lines(tmp_path / "q_questions.txt", text)).collect()
    assert {(r.number, r.gold) for r in got} == {(1, "B"), (3, "A")} and any("A one" in r.prompt and "Correct" not in r.prompt for r in got)


def test_glossed_words_keep_boundaries_and_drop_misaligned(spark):
    rows = [("a", "o wōlē-0=n 'ēqē-k", "INTERJ you.know-ZERO=ART garden-1SG"), ("b", "one two", "ONE"), ("c", "x-y z", "X Z"), ("d", None, "X")]
    df = spark.createDataFrame(rows, "id string, segmentation string, glosses string")
    got = [tuple(r) for r in readers.glossed_words(df, ["id"]).orderBy("id", "at", "morph").collect()]
    assert got[1:4] == [("a", 1, "wōlē0n", 0, "wōlē", "you.know", ""), ("a", 1, "wōlē0n", 1, "0", "ZERO", "-"), ("a", 1, "wōlē0n", 2, "n", "ART", "=")]
    assert {g[0] for g in got} == {"a", "c"} and [g for g in got if g[0] == "c"] == [("c", 1, "z", 0, "z", "Z", "")]


def test_score_card_is_stable(spark):
    a = writers.score_card(spark.createDataFrame([(1, 0.5)], "z int, a double")).collect()[0]
    b = writers.score_card(spark.createDataFrame([(0.5, 1)], "a double, z int")).collect()[0]
    assert a.card == b.card == '{"a":0.5,"z":1}' and a.hash == b.hash and len(a.hash) == 16


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", "s", 0.5, 2)], "target string, source string, prob double, count bigint")
    writers.write_gloss_tsv(df, str(tmp_path / "g"))
    assert [tuple(r) for r in readers.gloss_tsv(spark, str(tmp_path / "g")).collect()] == [("t", "s", 0.5, 2)]
    writers.write_json_lines(df, str(tmp_path / "j"), ["target"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert readers.latest_by(spark.createDataFrame([("a", 1), ("a", 2)], "k string, o int"), ["k"], "o").collect()[0].o == 2


def test_dictionaries_catalogs_and_inventories(spark, tmp_path):
    dump = readers.dictionary_dump(spark, lines(tmp_path / "k.jsonl", '{"word": "Casa", "pos": "noun", "senses": [{"glosses": ["house", "home"]}], "forms": [{"form": "casas"}, {"form": "la casa"}]}\n{"word": "casa", "pos": "verb", "senses": [{"glosses": ["house"]}, {}]}\n'))
    assert [(r.word, r.pos, r.senses, r.forms) for r in dump.collect()] == [("casa", ["noun", "verb"], ["house", "home"], ["casas"])]
    terms = readers.key_terms(spark, lines(tmp_path / "t.json", '[{"name": "grace.md"}, {"name": "x.txt"}, {"name": "grace.md"}]'))
    assert [r.term for r in terms.collect()] == ["grace"]
    catalog = readers.audio_catalog(spark, lines(tmp_path / "c.json", '[{"target": "swh", "source_id": "s", "path": "a.wav"}, {"target": "x"}]'))
    assert catalog.count() == 1
    xml = lines(tmp_path / "g.xml", "<a:Root><!-- <LexEntry/> --><LexEntry id='1'><Sense/></LexEntry><n:LexEntry/><Other/></a:Root>")
    assert {tuple(r) for r in readers.element_counts(spark, xml, {"LexEntry": "entries", "Sense": "senses"}).collect()} == {("entries", 2), ("senses", 1)}


def test_lift_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("kata", "cat & dog", "noun"), ("x", None, None)], "form string, gloss string, pos string")
    writers.write_entries(df.coalesce(1), writers.lift_entry(F.col("form"), F.col("gloss"), F.col("pos")), str(tmp_path / "l"), "lift")
    assert {tuple(r) for r in readers.lift_entries(spark, str(tmp_path / "l")).collect()} == {("kata", "noun", "cat & dog"), ("x", "", "?")}


def test_nested_entries_and_pages(spark):
    changes = spark.createDataFrame([("lexical.entry.create", "kata", None, "noun"), ("lexical.sense.create", "kata", "cat", None), ("lexical.sense.create", "mbwa", "dog", None), ("x", "y", None, None)], "op string, key string, gloss string, pos string")
    assert {(r.entry, r.lexeme_form, tuple(r.senses), r.pos) for r in writers.nested_entries(changes).collect()} == {("kata", "kata", ("cat",), "noun"), ("mbwa", "mbwa", ("dog",), None)}
    t = spark.createDataFrame([("t1", "p", "pos", "open", None, ["a?", None])], "id string, pair string, type string, status string, ctx string, o array<string>")
    assert t.select(writers.ticket_page("id", "pair", "type", "status", "ctx", "o")).collect()[0][0] == "# t1\np · pos · open\n\n\n\n1. a?\n2. "
