import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from morphloom.llm import cooccur

ROWS = "pair string, chunk bigint, target string, word string, items string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], ROWS)


def pieces(spark, data, **kw):
    return cooccur.pieces_of(rows(spark, data), "pair", ["chunk", "target"], "word", **kw)


def deltas(spark, data, **kw):
    return cooccur.changed(cooccur.pair_rows(pieces(spark, data, **kw)))


def change(spark, before, after, **kw):
    """The signed rows from one content of the baskets to another."""
    both = rows(spark, before).withColumn("side", F.lit(1)).unionByName(rows(spark, after).withColumn("side", F.lit(2)))
    return cooccur.pair_rows(cooccur.pieces_of(both, "pair", ["chunk", "target"], "word", "side", **kw))


def brute(data):
    sets = {}
    for p, c, t, w in data:
        if w is not None:
            sets.setdefault((p, c, t), set()).add(w)
    both, one, total = Counter(), Counter(), Counter()
    for (p, _, _), words in sets.items():
        total[p] += 1
        one.update((p, w) for w in words)
        both.update((p, *x) for x in combinations(sorted(words), 2))
    return {(p, a, b, n, one[p, a], one[p, b], total[p]) for (p, a, b), n in both.items()}


def found(state, **kw):
    return {tuple(r) for r in cooccur.associations(state, **kw).collect()}


def sample(seed, n=600):
    draw = random.Random(seed)
    return [(draw.choice(["p", "q", None]), draw.choice([1, 2, 3, None]), "hot" if draw.random() < 0.3 else draw.choice([f"t{draw.randint(0, 30)}", None]), draw.choice([f"w{draw.randint(0, 12)}", None, ""])) for _ in range(n)]


def test_counts_against_brute_force(spark):
    data = sample(1)
    state = cooccur.PairTable(spark).apply(deltas(spark, data)).state()
    assert found(state) == brute(data)
    assert found(deltas(spark, data, near="target", hot={"hot": 5})) == brute(data)
    cut = cooccur.pieces_of(rows(spark, data).withColumn("part", F.col("chunk")), "pair", ["chunk", "target"], "word", within="part", near="target", hot={"hot": 3})
    assert found(cooccur.changed(cooccur.pair_rows(cut))) == brute(data)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_large_baskets_are_cut_into_blocks(spark, block):
    before, after = sample(5, 300), sample(5, 300)[:200] + sample(6, 100)
    cut = change(spark, before, after, near="target", block=block)
    assert found(cooccur.loaded(cut)) == brute(before)
    assert found(cooccur.merge(cooccur.loaded(cut), cooccur.changed(cut))) == brute(after)
    sizes = pieces(spark, [("p", 1, "t", f"w{i:04}") for i in range(40 * block)], block=block).selectExpr("size(items) AS n", "i", "j").collect()
    assert max(r.n for r in sizes) <= 12 * block and len({(r.i, r.j) for r in sizes}) == len(sizes)


def test_items_and_spaces_with_separators(spark):
    data = [("a\x1fb", 1, "t\x1b", w) for w in ("\x1f", "\x1b", "\x1bs", "\x1bn", "x\x1fy", "")] + [("a", 1, "b", "x")]
    assert found(deltas(spark, data)) == brute(data)
    df = spark.createDataFrame([("\x1f\x1b", None, "")], "a string, b string, c string")
    assert tuple(df.select(cooccur.packed(F.col("a"), F.col("b"), F.col("c")).alias("x")).select(*cooccur.unpacked(F.col("x"), ["a", "b", "c"])).collect()[0]) == ("\x1f\x1b", None, "")


def test_changed_baskets_give_what_a_rebuild_gives(spark, tmp_path):
    before, after = sample(2), sample(2)[:400] + sample(3, 150)
    folder = f"file://{tmp_path}/pairs"
    table = cooccur.PairTable(spark, folder, buckets=3, least=2).apply(deltas(spark, before))
    want = {r for r in brute(before) if r[3] >= 2}
    assert {tuple(r) for r in table.associations().collect()} == want
    again = cooccur.PairTable(spark, folder)  # opened from its manifest alone
    assert again.generation == 1 and again.manifest["buckets"] == 3
    again.apply(cooccur.changed(change(spark, before, after)))
    assert found(again.state()) == brute(after) and again.generation == 2
    assert {tuple(r) for r in again.associations().collect()} == {r for r in brute(after) if r[3] >= 2}
    assert {tuple(r) for r in cooccur.PairTable(spark, folder).associations().collect()} == {r for r in brute(after) if r[3] >= 2}
    assert len([n for n in (tmp_path / "pairs").iterdir() if n.name.startswith("manifest")]) == 1
    assert not (tmp_path / "pairs/generation-00000001/delta").exists()  # superseded


def test_only_affected_pairs_are_scored_again(spark, monkeypatch):
    before = [("p", i, "t", w) for i in range(4) for w in ("a", "b")] + [("p", i, "u", w) for i in range(4) for w in ("c", "d")]
    table = cooccur.PairTable(spark, least=2).apply(deltas(spark, before))
    assert table.scores().count() == 2
    table.apply(cooccur.changed(change(spark, before, before + [("p", 9, "t", "a")])))
    asked = []
    real = cooccur.scored
    monkeypatch.setattr(cooccur, "scored", lambda state, least, pairs=None: asked.append(pairs.count()) or real(state, least, pairs))
    assert {(r.word_a, r.word_b, r.n_a) for r in table.scores().collect()} == {("a", "b", 5), ("c", "d", 4)}
    assert asked == [1]


def test_unchanged_baskets_emit_nothing(spark):
    one = sample(4)
    assert cooccur.changed(change(spark, one, one)).count() == 0


def test_a_basket_that_goes_away(spark):
    table = cooccur.PairTable(spark, buckets=2).apply(deltas(spark, sample(4)))
    assert table.apply(cooccur.changed(change(spark, sample(4), []))).state().count() == 0
    assert table.associations().count() == 0


def test_thresholds_are_exact_at_the_edge(spark):
    data = [("p", i, "t", w) for i in range(5) for w in "ab"] + [("p", 100 + i, "t", "c") for i in range(35)]
    state = deltas(spark, data)
    assert len(found(state, least=5, lift=8)) == 1  # 5 x 40 = 8 x 5 x 5
    assert found(state, least=5, lift=9) == found(state, least=6, lift=1) == set()


def test_a_large_basket(spark):
    state = deltas(spark, [("p", 1, "t", f"w{i:04}") for i in range(700)], block=100)
    assert state.filter("b is not null").count() == 700 * 699 // 2
    assert state.filter("a is null").collect()[0].n == 1 and state.filter("a is not null and b is null").count() == 700


def test_empty(spark):
    table = cooccur.PairTable(spark).apply(deltas(spark, []))
    assert table.state().count() == 0 and found(table.state()) == set() and table.associations().count() == 0


def test_items_with_one_code_are_refused_whenever_they_come(spark):
    table = cooccur.PairTable(spark, buckets=7)
    one = lambda space, item: spark.createDataFrame([(7, None, space, item, 1)], cooccur.SCHEMA)
    table.apply(one("p", "x"))
    for space, item in (("p", "y"), ("q", "x")):
        with pytest.raises(ValueError, match="seed"):
            table.apply(one(space, item))
    assert table.generation == 1 and table.state().count() == 1


def test_buckets_follow_the_size():
    assert cooccur.buckets_for(0, 12) == 24 and cooccur.buckets_for(30 << 30, 200) == 2000 and cooccur.buckets_for(1 << 60, 3000) == 9000
