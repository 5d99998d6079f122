"""Expectation maximisation against a plain second implementation, and what it leaves on disk."""

import os
import random
from collections import Counter, defaultdict

import pytest

from morphloom import session
from morphloom.operators import align, em

SIDE = "space string, row string, at int, word string"


def plain(source, target, rounds, keep):
    words = {side: defaultdict(Counter) for side in "st"}
    for side, rows in (("s", source), ("t", target)):
        for space, row, _, word in rows:
            if None not in (space, row, word):
                words[side][space, row][word] += 1
    met = defaultdict(set)
    for space, row in words["s"].keys() & words["t"].keys():
        for s in words["s"][space, row]:
            met[space, s] |= set(words["t"][space, row])
    prob = {(space, t, s): 1 / len(ts) for (space, s), ts in met.items() for t in ts}
    for _ in range(rounds):
        c, total = Counter(), Counter()
        for space, row in words["s"].keys() & words["t"].keys():
            for t, n_t in words["t"][space, row].items():
                w = {s: n * prob.get((space, t, s), 0) for s, n in words["s"][space, row].items()}
                for s, x in w.items():
                    if x:
                        c[space, t, s] += n_t * x / sum(w.values())
        for (space, _, s), x in c.items():
            total[space, s] += x
        prob = {k: x / total[k[0], k[2]] for k, x in c.items() if x / total[k[0], k[2]] > keep}
    return prob


@pytest.fixture(scope="module")
def text():
    pick = random.Random(5)
    source, target = [], []
    for row in range(60):
        space = pick.choice(["x", "y"])
        for rows, names in ((source, "abcdefghijkl"), (target, "ABCDEFGHIJKLMNO")):
            rows += [(space, f"r{row}", at, word) for at, word in enumerate(["Z" if rows is target else "z", *pick.choices(names, k=pick.randint(0, 7))])]
    source += [("x", "r1", 50, None), ("x", None, 0, "a"), (None, "r1", 0, "a"), ("x", "alone", 0, "lonely")]
    target += [("x", "r1", 50, None), ("x", None, 0, "A"), (None, "r1", 0, "A"), ("y", "other", 0, "Q")]
    return source, target


@pytest.mark.parametrize(("met", "rounds", "keep"), [(1 << 21, 5, 1e-6), (1 << 21, 3, 0.03), (40, 3, 0.03), (3, 5, 1e-6), (40, 0, 1e-6)])
def test_em_equals_a_plain_second_implementation(spark, text, monkeypatch, met, rounds, keep):
    monkeypatch.setattr(em, "MET", met)
    got = align.em_table(*[spark.createDataFrame(rows, SIDE) for rows in text], rounds, keep)
    assert got.columns == ["space", "target", "source", "prob"]
    found = got.collect()
    want = plain(*text, rounds, keep)
    assert len(found) == len(want) and {tuple(r)[:3]: r.prob for r in found} == pytest.approx(want, rel=1e-9)


def test_em_leaves_no_table_of_pairs_on_disk(spark):
    rows = 60
    source = spark.createDataFrame([("x", f"r{r}", at, f"s{(r * 7 + at * at) % 400}") for r in range(rows) for at in range(50)], SIDE)
    target = spark.createDataFrame([("x", f"r{r}", at, f"t{r}.{at}") for r in range(rows) for at in range(50)], SIDE)
    before = len(session._WRITTEN)
    pairs = align.em_table(source, target, 5).count()
    written = [path.removeprefix("file://") for path in session._WRITTEN[before:]]
    size = sum(os.path.getsize(os.path.join(at, f)) for path in written for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))
    assert pairs > 50_000 and size < 8 * pairs


def test_em_of_nothing(spark):
    none = spark.createDataFrame([], SIDE)
    some = spark.createDataFrame([("x", "r", 0, "a")], SIDE)
    assert align.em_table(none, none).count() == 0 and align.em_table(some, none).count() == 0
