"""Counts into decisions: votes, entropy, gain, lift, overlap, rank correlation, association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, support: int = 1, share: float = 0.0) -> DataFrame:
    """(keys, value, n, total, share): the most frequent value of each key.

    Ties go to the smallest value. Only keys whose best value has at least
    ``support`` occurrences and ``share`` of the key's total. Null values do not
    vote. Groups are counted before they are ranked, so a key's rows never meet.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    key = Window.partitionBy(*keys)
    ranked = counted.withColumn("total", F.sum("n").over(key)).withColumn("__place", F.row_number().over(key.orderBy(F.desc("n"), F.asc(value))))
    best = ranked.filter(F.col("__place") == 1).drop("__place").withColumn("share", F.col("n") / F.col("total"))
    return best.filter((F.col("n") >= support) & (F.col("share") >= share))


def entropy(counts: DataFrame, keys: list[str], n: str, name: str = "entropy") -> DataFrame:
    """(keys, entropy): Shannon entropy in bits of the positive weights of each key."""
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    p = F.col(n) / F.sum(n).over(total)
    shares = counts.filter(F.col(n) > 0).withColumn("__p", p)
    return shares.groupBy(*keys).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias(name))


def information_gain(counts: DataFrame, keys: list[str], label: str, side: str, n: str) -> DataFrame:
    """(keys, gain): entropy of the labels minus the count-weighted entropy of their distribution on each side."""
    both = counts.groupBy(*keys, label).agg(F.sum(n).alias("__n"))
    whole = entropy(both, keys, "__n", "h")
    per_side = entropy(counts, [*keys, side], n, "__h")
    sizes = counts.groupBy(*keys, side).agg(F.sum(n).alias("__size"))
    mixed = per_side.join(sizes, [*keys, side]).groupBy(*keys).agg((F.sum(F.col("__h") * F.col("__size")) / F.sum("__size")).alias("inside"))
    return whole.join(mixed, keys).select(*keys, (F.col("h") - F.col("inside")).alias("gain"))


def lift(rows: DataFrame, item: str, feature: str, base_rows: DataFrame, support: int = 6, share: float = 0.3, least: float = 1.6) -> DataFrame:
    """(item, feature, n, n_item, share, lift): features that items carry more often than all rows do.

    rows: one row for each (item, feature) occurrence, null feature where the
    item stands without one. base_rows: one row for each (row, feature). Gates use
    unrounded values; of several features the one with the highest lift rounded
    to two places wins, then the higher support, then the smaller name.
    """
    per = rows.filter(F.col(feature).isNotNull()).groupBy(item, feature).agg(F.count(F.lit(1)).alias("n"))
    items = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n_item"))
    base = base_rows.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.count(F.lit(1)).alias("n_base"))
    total = base.agg(F.sum("n_base").alias("n_all"))
    joined = per.join(items, item).join(base, feature)
    scored = joined.withColumn("share", F.col("n") / F.col("n_item")).withColumn("lift", F.col("share") / (F.col("n_base") / total.scalar()))
    gated = scored.filter((F.col("n") >= support) & (F.col("share") >= share) & (F.col("lift") >= least))
    order = Window.partitionBy(item).orderBy(F.round("lift", 2).desc(), F.desc("n"), F.asc(feature))
    return gated.withColumn("__place", F.row_number().over(order)).filter("__place = 1").select(item, feature, "n", "n_item", "share", "lift")


def set_overlap(members: DataFrame, owner: str, item: str, least: int = 1) -> DataFrame:
    """(left, right, shared, jaccard): owners that share at least ``least`` items.

    An equi-join on the item; items owned by everybody should be cut before.
    """
    distinct = members.select(F.col(owner).alias("o"), F.col(item).alias("i")).distinct()
    sizes = distinct.groupBy("o").agg(F.count(F.lit(1)).alias("size"))
    shared = (
        distinct.alias("x").join(distinct.alias("y"), F.col("x.i") == F.col("y.i")).filter(F.col("x.o") < F.col("y.o"))
        .groupBy(F.col("x.o").alias("left"), F.col("y.o").alias("right")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    )
    left, right = sizes.select(F.col("o").alias("left"), F.col("size").alias("n_left")), sizes.select(F.col("o").alias("right"), F.col("size").alias("n_right"))
    joined = shared.join(left, "left").join(right, "right")
    return joined.select("left", "right", "shared", (F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))).alias("jaccard"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): rank correlation with average ranks for ties; null where a side is constant."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def average_rank(column: str) -> Column:
        first = F.rank().over(Window.partitionBy(*keys).orderBy(column))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
        return first + (ties - 1) / 2

    ranked = clean.withColumn("__x", average_rank(x)).withColumn("__y", average_rank(y))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("rho"))


def adjacent_association(sequence: DataFrame, keys: list[str], row: str, position: str, item: str, least: int = 1) -> DataFrame:
    """(keys, first, second, n, association): neighbours more frequent than their parts make likely.

    association = (n/N) / ((n_first/N)(n_second/N) + 1e-9) with N items in all, for
    both single items and neighbours; no logarithm is taken.
    """
    after = F.lead(item).over(Window.partitionBy(*keys, row).orderBy(position))
    pairs = sequence.select(*keys, F.col(item).alias("first"), after.alias("second")).filter(F.col("second").isNotNull())
    both = pairs.groupBy(*keys, "first", "second").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    single = sequence.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__c"))
    total = single.groupBy(*keys).agg(F.sum("__c").alias("total"))
    one = single.select(*keys, F.col(item).alias("first"), F.col("__c").alias("n_first"))
    two = single.select(*keys, F.col(item).alias("second"), F.col("__c").alias("n_second"))
    joined = both.join(one, [*keys, "first"]).join(two, [*keys, "second"]).join(total, keys)
    expected = (F.col("n_first") / F.col("total")) * (F.col("n_second") / F.col("total")) + F.lit(1e-9)
    return joined.select(*keys, "first", "second", "n", ((F.col("n") / F.col("total")) / expected).alias("association"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if a side is empty, null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, F.nullif(norm(a) * norm(b), F.lit(0.0)))


def profile_overlap(profiles: DataFrame, form: str, dimension: str, bucket: str, n: str, edge: str = "#") -> DataFrame:
    """(left, right, dimension, overlap): sum over buckets of the smaller share; word edges do not count."""
    inside = profiles.filter(F.col(bucket) != edge)
    share = F.col(n) / F.sum(n).over(Window.partitionBy(form, dimension))
    shares = inside.select(F.col(form).alias("form"), F.col(dimension).alias("dimension"), F.col(bucket).alias("bucket"), share.alias("p"))
    x, y = shares.alias("x"), shares.alias("y")
    same = (F.col("x.dimension") == F.col("y.dimension")) & (F.col("x.bucket") == F.col("y.bucket"))
    joined = x.join(y, same).filter(F.col("x.form") < F.col("y.form"))
    return joined.groupBy(F.col("x.form").alias("left"), F.col("y.form").alias("right"), F.col("x.dimension").alias("dimension")).agg(
        F.sum(F.least("x.p", "y.p")).alias("overlap")
    )
