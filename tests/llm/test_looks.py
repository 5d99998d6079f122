import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from morphloom.llm import looks

CASES = [
    ("Latn", "ｋɛｍɛ", "kɛmɛ"), ("Latn", "ре​pe", "pepe"), ("Latn", "ạ̄", "ạ̄"), ("Latn", "a͏́", "á"), ("Latn", "n'a’b", "nʼaʼb"), ("Latn", "\ta b ", "a b"),
    ("Latn", "ǌa‐ﬂ", "nja-fl"), ("Latn", "𝚎𝚟", "ev"), ("Latn", "ı́", "í"), ("Latn", "É", "É"), ("Latn", "ŋɛ", "ŋɛ"), ("Latn", "", ""), ("Latn", "​", ""), ("Latn", "a  b", "a b"),
    ("Cyrl", "cаxap", "сахар"), ("Cyrl", "οкна", "окна"), ("Cyrl", "ёж", "ёж"), ("Cyrl", "ёж", "ёж"),
]


def test_looks_of_known_spellings():
    for script, text, want in CASES:
        assert looks.look(text, script) == want, (text, looks.look(text, script))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeoɛŋ '’̣́̄​аеоｅ -")), max_size=40), st.sampled_from(["Latn", "Cyrl"]))
def test_splicing_equals_converting_the_whole(text, script):
    made = looks.look(text, script)
    assert made == looks.canonical(text, script).strip(" ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeɛŋáéọ̄̃ -ʼ", max_size=30))
def test_plain_text_stays(text):
    plain = " ".join(unicodedata.normalize("NFC", text).split())
    if plain and unicodedata.combining(plain[0]) == 0:
        assert looks.look(plain, "Latn") == plain


def test_rows_are_led_back(spark):
    entries = [(1, "q", "pepa", "Latn"), (2, "q", "реpa", "Latn"), (3, "q", "pépa", "Latn"), (4, "z", "pepa", None)]
    lex = looks.with_look(spark.createDataFrame(entries, "entry_id bigint, pair string, text string, script string"), "text", "script")
    rows = [("t", 9, "q", "ｐepa", "Latn"), ("t", 9, "q", "ｐepa", "Latn"), ("t", 10, "q", "pepa", "Latn"), ("t", 11, "q", None, "Latn"), ("t", 12, "z", "ｐepa", "Cyrl"), ("t", 13, "q", "", "Latn"), ("t", 14, "q", "p" * 100_000 + "​", "Latn"), ("t", 15, None, "ｐepa", None)]
    df = looks.with_look(spark.createDataFrame(rows, "tab string, row_id bigint, pair string, text string, script string"), "text", "script")
    got = df.unionByName(lex.select("pair", "text", "script", "look", lex.entry_id.alias("row_id")).selectExpr("'lex' tab", "row_id", "pair", "text", "script", "look"))
    assert {tuple(r) for r in looks.lead_back(got, lex).collect()} == {("t", 9, 1), ("lex", 2, 1)}
    none = df.limit(0)
    assert looks.lead_back(none, lex).count() == 0 and looks.lead_back(df, lex.limit(0)).count() == 0


def test_the_quick_check_agrees_with_python(spark):
    texts = [(c, s) for _, *both in CASES for c in both for s in ("Latn", "Cyrl")]
    df = looks.with_look(spark.createDataFrame(texts, "t string, s string"), "t", "s")
    assert [(r.t, r.s, r.look) for r in df.collect()] == [(t, s, looks.look(t, s)) for t, s in texts]


def test_trailing_line_ends_are_converted(spark):
    texts = [f"word{end}" for end in ("\n", "\r\n", "\u0085", " ", "")]
    df = spark.createDataFrame([("Latn", t) for t in texts], "script string, text string")
    assert {(r.text, r.look) for r in looks.with_look(df, "text", "script").collect()} == {(t, looks.look(t, "Latn")) for t in texts} == {(t, "word") for t in texts}


def test_scripts_without_table_are_normalised_all_the_same(spark):
    rows = [("Grek", "ｋａλά"), (None, "ｋａλά​"), ("Grek", "n'а"), ("Grek", "plain")]
    got = looks.with_look(spark.createDataFrame(rows, "script string, text string"), "text", "script").collect()
    assert [r.look for r in got] == ["kaλά", "kaλά", "nʼа", "plain"]
