"""The queries of the llm operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.llm import abuse, cooccur, looks, packing, terms, tokens, topk
from morphloom.operators.live import hot_values, live_rows, live_subgroups, size_of, version_subgroups
from morphloom.plans.tables import table
from morphloom.session import materialise


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common: forms of markers by record, of entries and affixes by occurrences."""
    parts = []
    raw = table(spark, folder, "morph_markers").select("marker_id", "loaded_at", "pair", "verse", "form")
    (hot,) = hot_values(raw.select(cooccur.packed(F.col("pair"), F.col("verse")).alias("record")), "record")
    markers = live_subgroups(raw, "marker_id", "loaded_at")
    found = terms.term_frequencies(terms.merge_bitmaps(terms.term_bitmaps(terms.record_rows(markers, "form", ["pair", "verse"], "subgroup", hot))))
    parts.append(("morph_markers", terms.mark_terms(found, "records", 3, 0.02)))
    for name, key in (("lex_entries", "entry_id"), ("affixes", "affix_id")):
        # an entry is a record, and its id the record's number
        rows = live_subgroups(table(spark, folder, name).select(key, "updated_at", "form", "count"), key, "updated_at").filter((F.col("count") >= 0) & F.col("form").isNotNull())
        numbered = rows.select("subgroup", F.col("form").alias("term"), F.col(key).alias("number"), F.col("count").alias("n"))
        found = terms.term_frequencies(terms.merge_bitmaps(terms.term_bitmaps(numbered, "subgroup")))
        parts.append((name, terms.mark_terms(found, "occurrences", 3, 0.01)))
    tabs = [df.select(F.lit(tab).alias("tab"), "term", "mark") for tab, df in parts]
    return tabs[0].unionByName(tabs[1]).unionByName(tabs[2])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three best candidates of every target word of a pair."""
    wanted = ["cand_id", "loaded_at", "pair", "target_word", "source_word", "prob", "count"]
    live = live_subgroups(table(spark, folder, "gloss_candidates").select(*wanted), "cand_id", "loaded_at").drop("loaded_at")
    good = live.filter(F.col("target_word").isNotNull() & F.col("source_word").isNotNull() & ~F.isnan("prob") & F.col("prob").between(0.0, 1.0))
    good = good.withColumn("prob", F.col("prob") + F.lit(0.0))
    order = [F.col("prob").desc(), F.col("count").desc_nulls_last(), F.col("source_word").asc(), F.col("cand_id").asc()]
    return topk.top_n(good, ["pair", "target_word"], order, 3, "cand_id", "subgroup").select("pair", "target_word", "place", "cand_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Words that look like an entry of their pair's lexicon but are stored with other characters."""
    scripts = table(spark, folder, "lang_pairs").groupBy("pair").agg(F.min("script").alias("script"))

    def looked(name: str, key: str, text: str) -> DataFrame:
        rows = table(spark, folder, name).select(F.lit(name).alias("tab"), F.col(key).alias("row_id"), "pair", F.col(text).alias("text"))
        return looks.with_look(rows.join(F.broadcast(scripts), "pair", "left"), "text", "script").filter(F.col("look").isNotNull())

    tabs = [looked("gemma_proposals", "prop_id", "word"), looked("morph_markers", "marker_id", "form"), looked("lex_entries", "entry_id", "form")]
    rows = tabs[0].unionByName(tabs[1]).unionByName(tabs[2])
    entries = tabs[2].select(F.col("row_id").alias("entry_id"), "pair", "text", "look")
    return looks.lead_back(rows, entries)


def _basket_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The baskets of gloss_candidates before late versions arrived (an id's first version) and after (its live one)."""
    # a row that is no support keeps its id and time, so that it still replaces older versions, but travels without its words
    rows = table(spark, folder, "gloss_candidates")
    support = F.col("target_word").isNotNull() & F.col("source_word").isNotNull() & (F.col("count") >= 2)
    ids, words = hot_values(rows, "cand_id", "target_word")
    names = ["pair", "target_word", "source_word"]
    lean = rows.select("cand_id", "loaded_at", F.when(support, F.col("chunk_id")).alias("chunk_id"), F.when(support, cooccur.packed(*map(F.col, names))).alias("words"))
    versions = version_subgroups(lean, "cand_id", "loaded_at", hot=ids).filter(F.col("words").isNotNull())
    rows = versions.select("chunk_id", "sides", "subgroup", *cooccur.unpacked(F.col("words"), names))
    return cooccur.pieces_of(rows, "pair", ["chunk_id", "target_word"], "source_word", "sides", within="subgroup", near="target_word", hot=words)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source words that stand together under one target word of a chunk far more often than chance.

    The table of pairs is loaded with the first version of every candidate and
    scored; the late versions then arrive as signed deltas, and what they affect is
    scored again.
    """
    unit = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch = materialise(cooccur.pair_rows(_basket_pieces(spark, folder)), "pair-rows")
    counts = cooccur.PairTable(spark, buckets=cooccur.buckets_for(size_of(table(spark, folder, "gloss_candidates")), unit), least=5)
    counts.apply(cooccur.loaded(batch)).scores()
    counts.apply(cooccur.changed(batch))
    return counts.associations(lift=8).select(F.col("space").alias("pair"), "word_a", "word_b")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as the list of its byte_bpe_50k ids."""
    return tokens.encode_column(table(spark, folder, "documents"), "doc_id", "text")


#: Tokens a container holds.
CAPACITY = 4096


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container."""
    return packing.pack(tokens.count_column(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "tokens", CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that packing had to split."""
    return p7_pack(spark, folder).filter(F.col("piece") == 2).select("doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The packing's containers, tokens and unused share."""
    packed = p7_pack(spark, folder).filter(F.col("container").isNotNull())
    filled = packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return filled.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.lit(CAPACITY)), 6))


#: The model of each state of the tables, so that the queries of a session train it once. Holds one at a time.
_MODELS: dict[tuple, abuse.Model] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def _abuse_model(spark: SparkSession, folder: str) -> abuse.Model:
    names = ("documents", "doc_labels", "abuse_terms", "lang_pairs")
    state = tuple(_stamp(spark, f"{folder}/{n}.parquet") for n in names)
    if state not in _MODELS:
        model = abuse.learn(*[table(spark, folder, n) for n in names])
        _MODELS.clear()
        _MODELS[state] = model
    return _MODELS[state]


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score for abusive, hateful or sexual content."""
    return abuse.score_documents(table(spark, folder, "documents"), _abuse_model(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose score reaches the threshold."""
    return p8_scores(spark, folder).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(source, documents, flagged, rate): the share of cases in every source; a null source is one of its own."""
    scored = abuse.score_documents(table(spark, folder, "documents"), _abuse_model(spark, folder), keep=("source",))
    flagged = F.sum(F.when(F.col("score") >= abuse.THRESHOLD, 1).otherwise(0)).alias("flagged")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), flagged).withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The offending sentences of every document."""
    return abuse.locate_sentences(table(spark, folder, "documents"), _abuse_model(spark, folder))
