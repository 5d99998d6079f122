from hypothesis import given, settings
from hypothesis import strategies as st

from morphloom.llm import tokens

ONE = tokens.Encoder(tokens.default_vocabulary())
MIXED = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'sdtlreové.,…“” 　 \u0085123abc<|>")), max_size=80)


@settings(max_examples=600, deadline=None)
@given(MIXED)
def test_fragments_encode_to_the_ids_of_the_whole(text):
    assert ONE.encode(text) == (ONE.bpe.encode_ordinary(text) if text else [])


def test_known_difficult_texts():
    for text in ["it's  we're\n\n  …'s", "<|endoftext|>", " ", "\n \n", "a\u0085'll", "x" * 50_000, "ab " * 50_000, "ünïcödé " * 2000, "👩‍👩‍👧 " * 50, "'" * 999]:
        assert ONE.encode(text) == ONE.bpe.encode_ordinary(text)


def test_fragments_are_the_text():
    raw = "Well, it's …  fine — “quoted”.".encode()
    assert b"".join(ONE.fragments(raw)) == raw and len(ONE.fragments(raw)) > 3


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 10)
    one = tokens.Encoder(tokens.default_vocabulary())
    text = " ".join(f"w{i}" for i in range(500))
    assert one.encode(text) == one.bpe.encode_ordinary(text) and len(one.memo) <= 10


def test_columns(spark):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (4, "Hello, world"), (None, "é"), (6, "tok " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash")})
    got = tokens.encode_column(df, "doc_id", "text", ids_per_batch=100).collect()
    want = {(k, tuple(ONE.bpe.encode_ordinary(t) if t else [])) for k, t in rows}
    assert len(got) == 6 and {(r.doc_id, tuple(r.ids)) for r in got} == want
    assert {(r.doc_id, r.tokens) for r in tokens.count_column(df, "doc_id", "text").collect()} == {(k, len(i)) for k, i in want}
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_ids_equal_those_of_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ["Der Präfix ạ̄- «mother.quick» <|endoftext|> 3,14", "a b　c  d\n"]:
        assert ONE.encode(text) == other.encode(text, add_special_tokens=False).ids
