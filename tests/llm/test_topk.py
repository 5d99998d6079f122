import random

from pyspark.sql import functions as F

from morphloom.llm.topk import top_n

def order():
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def brute(rows, n):
    groups = {}
    for g, i, s, *_ in rows:
        groups.setdefault(g, []).append((s is None, -(s or 0), i))
    return {(g, i, k) for g, xs in groups.items() for k, (_, _, i) in enumerate(sorted(xs)[:n], 1)}


def found(df, n, **kw):
    return {(r.g, r.id, r.place) for r in top_n(df, ["g"], order(), n, "id", **kw).collect()}


def test_against_brute_force_with_ties_nulls_and_a_hot_group(spark):
    draw = random.Random(5)
    rows = [("hot" if i % 3 == 0 else draw.choice(["a", "b", None, f"g{i % 50}"]), i, draw.choice([0.1, 0.2, 0.3, None]), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, score double, __salt string").repartition(7)
    assert found(df, 3) == brute(rows, 3)
    assert found(df.withColumn("part", F.col("id") % 5), 3, subgroups="part") == brute(rows, 3)


def test_empty_and_small(spark):
    assert found(spark.createDataFrame([], "g string, id int, score double"), 3) == set()
    assert found(spark.createDataFrame([("a", 1, None)], "g string, id int, score double"), 3) == {("a", 1, 1)}


def test_groups_are_limited_before_every_exchange(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "g string, id int, score double")
    plan = top_n(df, ["g"], order(), 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == plan.count("Exchange hashpartitioning") == 2
