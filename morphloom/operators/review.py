"""Review of tickets: gates, queues, dependencies, impact, lifecycle, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed steps of a ticket's life.
STEPS = {("open", "in_review"), ("in_review", "resolved"), ("in_review", "wont_fix"), ("resolved", "open"), ("wont_fix", "open"), ("open", "resolved"), ("open", "wont_fix")}


def signals_concur(conf: Column, top: Column, gloss: Column) -> Column:
    """A proposal that is sure and agrees with the aligner: high, and the aligner's word is one of the gloss's."""
    words = F.regexp_extract_all(F.lower(gloss), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.coalesce((conf == "high") & F.array_contains(words, F.lower(top)), F.lit(False))


def gate(proposals: DataFrame, conf: str, top: str, gloss: str) -> DataFrame:
    """``proposals`` with column accepted."""
    return proposals.withColumn("accepted", signals_concur(F.col(conf), F.col(top), F.col(gloss)))


def escalated(priority: Column, dependencies: Column, least: int = 3) -> Column:
    """Whether a ticket goes up: high priority, or at least so many dependencies."""
    return F.coalesce(priority == "high", F.lit(False)) | (F.size(F.coalesce(dependencies, F.array().cast("array<string>"))) >= least)


def queue(tickets: DataFrame) -> DataFrame:
    """``tickets`` (id, status, priority, score, dependencies) with column place: the order of review.

    By priority (high, medium, low, none), falling score, more dependencies, id.
    One window over the open tickets; they are a work list, not a corpus, and are
    ranked by status.
    """
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).when(F.col("priority") == "low", 2).otherwise(3)
    order = Window.partitionBy("status").orderBy(level, F.desc_nulls_last("score"), F.size(F.coalesce("dependencies", F.array().cast("array<string>"))).desc(), F.asc("id"))
    return tickets.withColumn("place", F.row_number().over(order).cast("bigint"))


def linked(tickets: DataFrame, keys: list[str], form: str, identifier: str = "id", prefix: int = 4) -> DataFrame:
    """(id, links): how many other tickets stand on a form with the same beginning."""
    keyed = tickets.filter(F.length(form) >= prefix).withColumn("__head", F.substring(form, 1, prefix))
    sizes = keyed.groupBy(*keys, "__head").agg(F.countDistinct(identifier).alias("n"))
    return keyed.join(sizes, [*keys, "__head"]).select(identifier, (F.col("n") - 1).alias("links")).distinct()


def impact(forms: DataFrame, vocabulary: DataFrame, keys: list[str], prefix: int = 4) -> DataFrame:
    """(keys, form, freq, related, affected, priority): what a decision on a form would touch.

    freq is the form's own frequency, related the number of other words with the
    same beginning, affected their frequency; priority is high from 200 tokens
    touched, medium from 30. vocabulary: (keys, word, n).
    """
    head = F.substring("word", 1, prefix)
    groups = vocabulary.filter(F.length("word") >= prefix).groupBy(*keys, head.alias("__head")).agg(F.count(F.lit(1)).alias("g_types"), F.sum("n").alias("g_n"))
    own = vocabulary.select(*keys, F.col("word").alias("form"), F.col("n").alias("freq"))
    asked = forms.select(*keys, "form").distinct().join(own, [*keys, "form"], "left").withColumn("__head", F.when(F.length("form") >= prefix, F.substring("form", 1, prefix)))
    joined = asked.join(groups, [*keys, "__head"], "left")
    freq, known = F.coalesce("freq", F.lit(0)), F.col("freq").isNotNull().cast("int")
    long = F.col("__head").isNotNull().cast("int")
    related = F.coalesce("g_types", F.lit(0)) - known * long
    affected = F.coalesce("g_n", F.lit(0)) - freq * long
    touched = freq + affected
    return joined.select(*keys, "form", freq.alias("freq"), related.alias("related"), affected.alias("affected"), F.when(touched >= 200, "high").when(touched >= 30, "medium").otherwise("low").alias("priority"))


def check_steps(history: DataFrame) -> DataFrame:
    """(id, steps, broken): how many steps a ticket's history has and how many are not allowed or do not follow the last."""
    order = Window.partitionBy("id").orderBy("at")
    allowed = F.lit(False)
    for a, b in sorted(STEPS):
        allowed = allowed | ((F.col("from_status") == a) & (F.col("to_status") == b))
    follows = F.coalesce(F.lag("to_status").over(order) == F.col("from_status"), F.lit(True))
    flagged = history.withColumn("__bad", (~(F.coalesce(allowed, F.lit(False)) & follows)).cast("int"))
    return flagged.groupBy("id").agg(F.count(F.lit(1)).alias("steps"), F.sum("__bad").cast("bigint").alias("broken"))


def recycled(tickets: DataFrame) -> DataFrame:
    """(id, resolved): open tickets that depend on a resolved one, which have to be assessed again."""
    needs = tickets.filter(F.col("status").isin("open", "in_review")).select("id", F.explode("dependencies").alias("resolved"))
    return needs.join(tickets.filter(F.col("status") == "resolved").select(F.col("id").alias("resolved")), "resolved", "left_semi").select("id", "resolved").distinct()


def precision(judged: DataFrame, keys: list[str], accepted: str, truth: str) -> DataFrame:
    """(keys, accepted, right, precision): how many accepted rows agree with the truth, of those that have one."""
    known = judged.filter(F.col(truth).isNotNull())
    sums = known.groupBy(*keys).agg(F.sum(F.col(accepted).cast("int")).alias("accepted"), F.sum((F.col(accepted) & F.col(truth)).cast("int")).alias("right"))
    return sums.withColumn("precision", F.try_divide("right", "accepted"))
