"""Sinks: JSON lines, gloss tables, dictionaries as XML, token streams, hashed score cards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """JSON lines; sorted within each file by ``sort``."""
    (df if not sort else df.repartitionByRange(*sort).sortWithinPartitions(*sort)).write.mode("overwrite").json(path)


def write_gloss_tsv(df: DataFrame, path: str) -> None:
    """(target, source, prob, count) as tab-separated text with a header."""
    df.select("target", "source", "prob", "count").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def escape(text: Column) -> Column:
    """Text fit for XML."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def bilingual_entry(reference: Column, reference_tags: Column, vernacular: Column, vernacular_tags: Column) -> Column:
    """One dictionary entry as XML."""
    tags = lambda t: F.array_join(F.transform(t, lambda x: F.concat(F.lit('<s n="'), escape(x), F.lit('"/>'))), "")
    return F.concat(F.lit("<e><p><l>"), escape(reference), tags(reference_tags), F.lit("</l><r>"), escape(vernacular), tags(vernacular_tags), F.lit("</r></p></e>"))


def lift_entry(form: Column, gloss: Column, pos: Column) -> Column:
    """One lexicon entry as LIFT XML; the identifier is a hash of form and gloss, so equal entries have equal ones."""
    code = F.substring(F.sha2(F.concat_ws("|", form, gloss), 256), 1, 32)
    return F.concat(
        F.lit('<entry id="'), code, F.lit('"><lexical-unit><form lang="vern"><text>'), escape(form), F.lit('</text></form></lexical-unit><sense><grammatical-info value="'),
        escape(F.coalesce(pos, F.lit(""))), F.lit('"/><gloss lang="en"><text>'), escape(F.coalesce(gloss, F.lit("?"))), F.lit("</text></gloss></sense></entry>"),
    )


def write_entries(df: DataFrame, entry: Column, path: str, root: str = "dictionary") -> None:
    """XML entries as text, one a line; each file is a whole document with the root element ``root``."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["value"])
        yield line(f"<{root}>")
        yield from batches
        yield line(f"</{root}>")

    df.select(entry.alias("value")).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def stream_token(surface: Column, readings: Column) -> Column:
    """``^surface/lemma<tag>..$`` from an array of (lemma, tags)."""
    one = F.transform(readings, lambda r: F.concat(r["lemma"], F.array_join(F.transform(r["tags"], lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")))
    return F.concat(F.lit("^"), surface, F.lit("/"), F.array_join(one, "/"), F.lit("$"))


def score_card(df: DataFrame) -> DataFrame:
    """``df`` with columns card (JSON with sorted members) and hash (the first 16 digits of its SHA-256)."""
    card = F.to_json(F.struct(*sorted(df.columns)))
    return df.withColumn("card", card).withColumn("hash", F.substring(F.sha2(card, 256), 1, 16))


def nested_entries(changes: DataFrame) -> DataFrame:
    """(entry, lexeme_form, senses, pos): accepted lexical changes as nested entries; a missing form is the entry itself.

    changes: (op, key, gloss, pos).
    """
    rows = changes.filter(F.col("op").startswith("lexical."))
    senses = F.array_sort(F.collect_set(F.when(F.col("op") == "lexical.sense.create", F.col("gloss"))))
    form = F.max(F.when(F.col("op") == "lexical.entry.create", F.col("key")))
    return rows.groupBy(F.col("key").alias("entry")).agg(F.coalesce(form, F.first("key")).alias("lexeme_form"), senses.alias("senses"), F.max("pos").alias("pos"))


def ticket_page(ticket: str, pair: str, kind: str, status: str, context: str, options: str) -> Column:
    """A ticket as markdown: heading, status, context and numbered options. The arguments name columns; options is an array of texts."""
    numbered = F.transform(F.coalesce(F.col(options), F.array().cast("array<string>")), lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(o, F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("# "), F.col(ticket)), F.concat_ws(" · ", pair, kind, status), F.lit(""), F.coalesce(F.col(context), F.lit("")), F.lit(""), F.array_join(numbered, "\n"))
