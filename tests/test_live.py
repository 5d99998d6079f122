from morphloom.operators import live

ROWS = [(1, 5, "a", None), (1, 7, "b", "x"), (1, 7, "b", "x"), (2, None, "c", None), (2, 1, "d", None), (None, 3, "e", None), (3, 4, "p", "q"), (3, 4, "z", None)]
WANT = {(1, 7, "b", "x"), (2, 1, "d", None), (None, 3, "e", None), (3, 4, "z", None)}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id bigint, t bigint, __place string, extra string")


def test_latest_row_of_each_id(spark):
    assert {tuple(r) for r in live.live_rows(table(spark), "id", "t").collect()} == WANT


def test_maps_break_ties_by_their_json(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x"}), (1, 1, {"a": "y"})], "id int, t int, m map<string,string>")
    assert live.live_rows(df, "id", "t").collect()[0].m == {"a": "y"}


def test_empty_table(spark):
    assert live.live_rows(table(spark, []), "id", "t").count() == 0
    assert live.live_subgroups(table(spark, []), "id", "t").count() == 0


def test_subgroups_give_the_same_rows(spark):
    got = live.live_subgroups(table(spark), "id", "t")
    assert {tuple(r)[:4] for r in got.collect()} == WANT


def hot_table(spark, monkeypatch):
    monkeypatch.setattr(live, "PROBE", 100)
    monkeypatch.setattr(live, "HOT", 10)
    monkeypatch.setattr(live, "ROWS_A_TASK", 500)
    return table(spark, [(7, i, f"v{i}", None) for i in range(2000)] + [(i, 1, "w", None) for i in range(100, 2100)])


def test_hot_ids_are_reduced_apart(spark, monkeypatch):
    df = hot_table(spark, monkeypatch)
    ids, places = live.hot_values(df, "id", "__place")
    assert list(ids) == [7] and list(places) == ["w"] and 2 <= ids[7] <= 6
    got = {tuple(r)[:3] for r in live.live_subgroups(df, "id", "t").collect()}
    assert (7, 1999, "v1999") in got and len(got) == 2001


def test_first_and_live_versions(spark, monkeypatch):
    got = {tuple(r)[:4] + (r.sides,) for r in live.version_subgroups(table(spark), "id", "t").collect()}
    assert got == {(1, 5, "a", None, 1), (1, 7, "b", "x", 2), (2, None, "c", None, 1), (2, 1, "d", None, 2), (None, 3, "e", None, 3), (3, 4, "p", "q", 1), (3, 4, "z", None, 2)}
    versions = live.version_subgroups(hot_table(spark, monkeypatch), "id", "t").collect()
    assert {(r.t, r.sides) for r in versions if r.id == 7} == {(0, 1), (1999, 2)} and len(versions) == 2002


def test_partitions_follow_the_size(spark, folder, monkeypatch):
    df = spark.read.parquet(f"{folder}/gloss_candidates.parquet")
    assert live.tasks_for(df) == 4 and 0 < live.size_of(df) < 10**8 and live.size_of(table(spark)) == 0
    monkeypatch.setattr(live, "BYTES_A_TASK", live.size_of(df) // 9)
    assert live.tasks_for(df) == 10


def test_versions_are_reduced_before_the_exchange(spark):
    plan = live.live_rows(table(spark), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
