import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphloom.llm import abuse, grams

KNOWN = abuse.lexicon([("bastard", "abuse", 3), ("cabrón", "abuse", 3)], ["Tolmari"])


def same_form(text, form):
    made = grams.words_of([text]).hashes
    return len(made) == 1 and (made == grams.hashes_of([form])).all()


def test_spellings_come_to_one_form():
    for text in ("bastard", "BASTARD", "b_a_s_t_a_r_d", "b a s t a r d", "b -a -s -t", "b@stard", "bаstаrd", "baaaastard", "ｂａｓｔａｒｄ", "bas\u200btard", "bästárd"):
        assert same_form(text, "bast" if "-" in text else "bastard"), text
    assert same_form("cabrón", "cabron") and same_form("v3rm1n", "vermin") and same_form("f!lth", "filth") and same_form("3.14", "#") and same_form("Straße", "strasse")
    idiot, idioot, idoit = grams.hashes_of(["idiot", "idioot", "idoit"])
    assert idiot[1] == idioot[1] and idiot[2] == idoit[2] and len({idiot[0], idioot[0], idoit[0]}) == 3


def split(text):
    found = grams.words_of([text])
    return [found.text(k) for k in range(len(found.owner))]


def test_sentences_do_not_break_inside_quotations():
    assert split("One two. See “dd! ee” ff.\nGo „hh? ii“ jj") == ["one two.", "see “dd! ee” ff.", "go „hh? ii“ jj"]
    assert split('He said "go. now." Then left.') == ['he said "go. now."', "then left."]
    assert split('an open " quote. two.') == ['an open " quote.', "two."]


@pytest.mark.parametrize("length", [10, 300, 5000])
def test_the_length_of_a_quotation_does_not_matter(length):
    assert len(split(f"One “{'word. ' * length}” two. Three four.")) == 2


def test_words_against_a_regular_expression():
    token = re.compile(r"[^\W_]+(?:[!@$|*€+£¡'’_.\-·~]+[^\W_]+)*[$!@]*")
    draw = random.Random(5)
    for _ in range(300):
        texts = ["".join(draw.choice("ab zé1 .!?\"„“_-@$\n’ñ\uffff") for _ in range(draw.randint(0, 40))) for _ in range(draw.randint(0, 6))]
        found = grams.words_of(texts)
        folded = "".join(map(chr, found.codes.tolist()))
        assert [m.start() for m in token.finditer(folded)] == found.starts.tolist(), texts
        assert (np.diff(found.at) >= 0).all() and (np.diff(found.owner) >= 0).all()
        assert found.owner.max(initial=0) < max(len(texts), 1)


def test_a_text_alone_gives_what_it_gives_in_a_group():
    texts = ["One two. Three!", None, "", "you “b a s t a r d” there", "x" * 3000]
    whole = abuse.features(texts, KNOWN)
    for i, text in enumerate(texts):
        alone = abuse.features([text], KNOWN)
        mine = np.flatnonzero(whole.words.owner == i)
        got = sorted((x, s - mine.min()) for ids, at in whole.parts for x, s in zip(ids.tolist(), at.tolist()) if s in mine) if len(mine) else []
        assert got == sorted((x, s) for ids, at in alone.parts for x, s in zip(ids.tolist(), at.tolist()))


def test_groups_hold_every_text_once():
    texts = ["a" * 10, None, "b" * 50, "", "c"]
    assert [t for _, g in grams.groups(texts, 20) for t in g] == texts and [s for s, _ in grams.groups(texts, 20)] == [0, 3]


def test_noisy_or_and_empty_texts():
    assert abuse.noisy_or(np.array([0.5, 0.5]), np.array([1, 1]), 3).tolist() == [0, 0.75, 0]
    for text in (None, "", "  \n", "!!!"):
        found = abuse.features([text], KNOWN)
        assert len(found.words.owner) == 0 and len(abuse.sentence_scores(found, np.zeros(1 << abuse.BITS), -4.0)) == 0


def test_votes_outweigh_a_lone_error():
    yes, no = np.array([3.0, 0, 1, 0] * 30), np.array([0.0, 3, 2, 2] * 30)
    post = abuse.vote_posteriors(yes, no)
    assert post[0] > 0.9 and post[1] < 0.05 and post[2] < 0.5


def corpus(n, seed):
    draw = np.random.default_rng(seed)
    calm = ["the reviewer copied the suffix", "ticket # asks about the root", "we recorded two speakers", "the verb takes an object", "the older speaker praised the form"]
    rude = ["you are a complete {}", "crawl back into your hole {}", "nobody wants you {}"]
    words = ["bastard", "fool", "dimwit", "b4stard"]
    rows = []
    for i in range(n):
        parts = [f"{draw.choice(calm)} {draw.integers(1000)}." for _ in range(draw.integers(1, 6))]
        case = draw.random() < 0.3
        if case:
            parts.insert(draw.integers(len(parts) + 1), draw.choice(rude).format(draw.choice(words)) + "!")
        rows.append((i, " ".join(parts), "s" if i % 3 else None, bool(case)))
    return rows


def test_held_out_accuracy_and_located_sentences(spark):
    rows = corpus(500, 1)
    draw = np.random.default_rng(2)
    votes = [(i, f"a{k}", int(case) if draw.random() > 0.05 else int(not case), k) for i, _, _, case in rows[:300] for k in range(2)] + [(1, "a9", None, 1), (9999, "a1", 1, 1)]
    documents = spark.createDataFrame([r[:3] for r in rows] + [(1000, None, None), (1001, "", None), (1002, "word " * 60_000, None)], "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(votes, "doc_id bigint, annotator string, flagged int, voted_at bigint")
    terms = spark.createDataFrame([("bastard", "en", "abuse", 3)], "term string, lang string, category string, strength int")
    languages = spark.createDataFrame([("Tolmari",)], "language string")
    model = abuse.learn(documents, labels, terms, languages)
    scores = {r.doc_id: r.score for r in abuse.score_documents(documents, model).collect()}
    assert len(scores) == 503 and scores[1000] == scores[1001] == 0
    right = [(scores[i] >= abuse.THRESHOLD) == case for i, _, _, case in rows[300:]]
    assert np.mean(right) >= 0.95
    located = abuse.locate_sentences(documents, model).collect()
    assert {r.doc_id for r in located} <= {i for i, s in scores.items() if s >= abuse.THRESHOLD}
    assert np.mean([any(w in r.sentence for w in ("you", "crawl", "nobody")) for r in located]) > 0.95


def test_no_labels_and_empty_tables(spark):
    documents = spark.createDataFrame([(1, "you bastard")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, annotator string, flagged int, voted_at bigint")
    terms = spark.createDataFrame([], "term string, lang string, category string, strength int")
    model = abuse.learn(documents, none, terms, spark.createDataFrame([], "language string"))
    assert abuse.score_documents(documents, model).collect()[0].score < 0.1
    assert abuse.score_documents(documents.limit(0), model).count() == 0
