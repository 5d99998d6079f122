import random

from pyspark.sql import functions as F

from morphloom.llm import cooccur, terms

SCHEMA = "term string, pair string, verse string, n bigint, record string"


def rows_of(df, **kw):
    return terms.record_rows(df.withColumn("part", F.pmod(F.hash("term", "verse"), F.lit(5))), "term", ["pair", "verse"], "part", **kw)


def stats(df, **kw):
    return {tuple(r) for r in terms.term_frequencies(terms.merge_bitmaps(terms.term_bitmaps(rows_of(df, **kw)))).collect()}


def sample(spark, n=5000):
    draw = random.Random(3)
    rows = [("the" if i % 3 == 0 else draw.choice(["a", "", "x:y\n\x1f", None, f"t{i % 90}"]), draw.choice(["p", None]), draw.choice([None, f"v{draw.randint(0, 400)}"]), 1, "r") for i in range(n)]
    want = {}
    for t, p, v, *_ in rows:
        if t is not None:
            for name in (t, None):
                c = want.setdefault(name, [0, set()])
                c[0] += 1
                c[1].add((p, v))
    return spark.createDataFrame(rows, SCHEMA), {(t, c[0], len(c[1])) for t, c in want.items()}


def test_against_brute_force_with_nulls_repeats_and_a_hot_term(spark):
    df, want = sample(spark)
    assert stats(df) == want


def test_records_with_very_many_rows_are_numbered_apart(spark):
    df, want = sample(spark)
    keys = [r[0] for r in df.select(cooccur.packed(F.col("pair"), F.col("verse"))).distinct().limit(5).collect()]
    assert stats(df, hot=dict.fromkeys(keys, 1)) == want


def test_integer_records_and_weights(spark):
    rows = [("a", -5, 2), ("a", -5, 3), ("a", None, 1), ("b", 1 << 40, 0), ("b", (1 << 40) + 63, 7), (None, 3, 4), ("c", 9, None), ("d", 65535, 1), ("d", 65536, 1)]
    df = spark.createDataFrame([(i % 2, *r) for i, r in enumerate(rows)], "lying int, term string, number bigint, n bigint")
    got = {tuple(r) for r in terms.term_frequencies(terms.merge_bitmaps(terms.term_bitmaps(df))).collect() if r[0] is not None}
    assert got == {("a", 6, 2), ("b", 7, 2), ("d", 2, 2)}


def test_merge_is_union_and_containers_are_compact(spark):
    df = spark.range(70_000).select(F.lit("all").alias("term"), F.col("id").alias("number"), F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("lying"))
    df = df.unionByName(spark.createDataFrame([("few", 63, 1, 0), ("few", 64, 1, 0), ("few", 70_000, 1, 0)], "term string, number bigint, n bigint, lying int"))
    once = terms.merge_bitmaps(terms.term_bitmaps(df.filter("term = 'all' OR number < 65536")), terms.term_bitmaps(df.filter("number >= 30000")))
    assert {tuple(r) for r in terms.term_frequencies(once).filter("term is not null").collect()} == {("all", 110_000, 70_000), ("few", 3, 3)}
    kept = {(r.term, r.chunk): (r.p, r.w) for r in once.selectExpr("term", "chunk", "size(bitmap.places) AS p", "size(bitmap.words) AS w").collect()}
    assert kept["few", 0] == (2, 0) and kept["all", 0] == (0, 1024)
    again = terms.merge_bitmaps(once, once)
    assert {(r.term, r.records) for r in terms.term_frequencies(again).collect()} == {(r.term, r.records) for r in terms.term_frequencies(once).collect()}


def test_record_numbers_are_distinct(spark):
    df = spark.createDataFrame([("x", None, None, 1, ""), ("x", "a", None, 1, ""), ("x", "a", "b", 1, ""), ("y", "a", "b", 1, "")], SCHEMA)
    got = rows_of(df).collect()
    assert len(got) == 4 and len({r.number for r in got}) == 3


def test_marks_and_empty_table(spark):
    freq = spark.createDataFrame([("a", 2), ("b", 3), ("c", 11), ("d", 10), (None, 100)], "term string, records bigint")
    assert {tuple(r) for r in terms.mark_terms(freq, "records", 3, 0.1).collect()} == {("a", "rare"), ("c", "common")}
    empty = spark.createDataFrame([], SCHEMA)
    assert stats(empty) == set()
    assert terms.mark_terms(freq.limit(0), "records", 3, 0.1).count() == 0
