import random

import pytest

from morphloom.llm import packing


def holds(groups, histogram, capacity):
    seen = {}
    for count, content in groups:
        assert count > 0 and sum(s * k for s, k in content.items()) <= capacity
        for s, k in content.items():
            seen[s] = seen.get(s, 0) + k * count
    return seen == {s: n for s, n in histogram.items() if n and s}


def test_plans_hold_every_item_and_waste_little():
    draw = random.Random(1)
    for scale, sizes in ((1, 40), (50, 300), (100_000, 900)):
        histogram = {draw.randint(1, 4096): draw.randint(1, 9) * scale for _ in range(sizes)} | {draw.randint(20, 600): 30 * scale for _ in range(100)}
        groups = packing.plan(histogram, 4096)
        assert holds(groups, histogram, 4096)
        used, least = sum(c for c, _ in groups), -(-sum(s * n for s, n in histogram.items()) // 4096)
        baseline = sum(c for c, _ in packing.best_fit([], dict(histogram), 4096))
        assert used <= max(baseline * 1.01 + 2, least)


def test_edges_of_the_histogram():
    for histogram in ({}, {4096: 3}, {1: 5}, {2049: 7}, {4096: 1, 1: 4096}, {0: 9, 5: 1}):
        assert holds(packing.plan(histogram, 4096), histogram, 4096)


def test_filling_is_the_best_one():
    import numpy as np

    worth = np.array([1.0, 2.5, 3.0, -1.0])
    assert packing.best_filling(worth, 4) == {2: 2}


def test_pack(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([7, 7, draw.randint(1, 120), 0, None, 250]), "c") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, container string")
    got = packing.pack(df, "doc_id", "size", 100, grain=1).collect()
    want = {(i, p): min(100, s - 100 * (p - 1)) for i, s, _ in rows if s for p in range(1, -(-s // 100) + 1)}
    assert {(r.doc_id, r.piece): r.tokens for r in got if r.tokens} == want and len(got) == len(want) + sum(not s for _, s, _ in rows)
    fill = {}
    for r in got:
        assert (r.container is None) == (r.tokens == 0)
        if r.tokens:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.03 * sum(fill.values()) / 100 + 1


@pytest.mark.parametrize("rows_a_task", [7, 1_000_000])
def test_pack_one_hot_size_and_nothing(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(packing, "ROWS_A_TASK", rows_a_task)
    hot = spark.createDataFrame([(i, 30) for i in range(1000)], "doc_id bigint, size bigint")
    assert packing.pack(hot, "doc_id", "size", 100, grain=10).select("container").distinct().count() == 334
    assert packing.pack(hot.limit(0), "doc_id", "size", 100).count() == 0
