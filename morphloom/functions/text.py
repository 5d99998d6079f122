"""Text as columns: tokens, word classes, shapes of words and glosses.

Every function takes and returns columns; nulls give nulls. Java's and Python's
ideas of letters differ at the edges, so the classes are spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: a letter, digit or underscore, and those or marks after it.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]*"
#: Marks that stand for a missing gloss, an empty prefix, the edge of a word, and the start of a sequence.
UNKNOWN, ZERO, EDGE, START = "?", "Ø", "#", "<s>"
VOWELS = "aeiouáéíóúàèìòùâêîôûäëïöüāēīōūɛɔəạọ"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form of a text. The engine has no function for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def tokens(text: Column, lower: bool = True, extra: str = "") -> Column:
    """The tokens of a text in order; ``extra`` are further characters allowed inside words."""
    pattern = TOKEN if not extra else rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}{extra}]*"
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), 0)


def is_alpha(word: Column) -> Column:
    """Letters only; words with combining marks are not."""
    return word.rlike(r"^\p{L}+\z")


def is_word_mark(word: Column) -> Column:
    """Letters and marks only."""
    return word.rlike(r"^[\p{L}\p{M}]+\z")


def is_word(token: Column) -> Column:
    """Letters, joined by single hyphens or apostrophes."""
    return token.rlike(r"^\p{L}+(?:[-'’]\p{L}+)*\z")


def is_number(token: Column, group: str = ",", decimal: str = ".") -> Column:
    """Digits, with group separators and at most one decimal mark, between any punctuation."""
    bare = F.regexp_replace(token, r"^[^\p{N}]+|[^\p{N}]+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"[{group}]", ""), rf"[{decimal}]", "").rlike(r"^\p{N}+\z") & (
        F.length(bare) - F.length(F.regexp_replace(bare, rf"[{decimal}]", "")) <= 1
    )


def token_class(token: Column) -> Column:
    """word, number, punctuation or other; the first that fits."""
    return (
        F.when(is_word(token), "word").when(is_number(token), "number").when(token.rlike(r"^[\p{P}\p{S}]+\z"), "punctuation").otherwise("other")
    )


def vowel_groups(word: Column) -> Column:
    """The number of vowel groups: an estimate of syllables."""
    return F.size(F.regexp_extract_all(F.lower(word), F.lit(f"[{VOWELS}]+"), 0))


def reduplicated(word: Column) -> Column:
    """The beginning that a word repeats at once (3, 2 or 1 characters with a vowel, and more after it), else null."""

    def at(k: int) -> Column:
        head = F.substring(word, 1, k)
        return F.when((head == F.substring(word, k + 1, k)) & (F.length(word) > 2 * k) & head.rlike(f"[{VOWELS}]"), head)

    return F.coalesce(at(3), at(2), at(1))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two words."""
    longest = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), longest), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.array_max(same)


def is_grammatical(gloss: Column) -> Column:
    """A gloss in capitals once digits, dots, blanks, slashes and brackets are gone."""
    bare = F.regexp_replace(gloss, r"[0-9.\s/()]", "")
    return (bare != "") & (bare == F.upper(bare)) & (F.upper(bare) != F.lower(bare))


def is_leipzig(tag: Column) -> Column:
    """All-capital glossing labels, digits and dots allowed."""
    return tag.rlike(r"^[A-Z0-9](?:[A-Z0-9._]*[A-Z0-9])?\z")


def gloss_slug(gloss: Column) -> Column:
    """The first sense of a gloss with underscores for blanks; ``?`` if there is none."""
    first = F.trim(F.regexp_extract(gloss, r"^([^;,(]*)", 1))
    return F.coalesce(F.nullif(F.regexp_replace(first, r"\s+", "_"), F.lit("")), F.lit(UNKNOWN))


def feature_map(bundle: Column) -> Column:
    """A ``;``-separated bundle of ``key=value`` as a map; of a repeated key the last counts."""
    pairs = F.filter(F.split(bundle, ";"), lambda x: F.contains(x, F.lit("=")))
    indexed = F.transform(pairs, lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), F.substr(x, F.instr(x, F.lit("=")) + 1).alias("v")))
    last = F.filter(indexed, lambda e: ~F.exists(indexed, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_arrays(F.transform(last, lambda e: e["k"]), F.transform(last, lambda e: e["v"]))


def canonical_key(features: Column) -> Column:
    """A feature map as text with sorted keys, fit for grouping."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def answer_letter(text: Column) -> Column:
    """The option letter an answer names: an explicit statement first, else the last letter that stands alone."""
    bare = F.regexp_replace(text, r"(?is)<think>.*?</think>", " ")
    said = F.regexp_extract(bare, r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*\(?\s*([A-D])\b", 1)
    alone = F.regexp_extract_all(F.upper(bare), F.lit(r"\b([A-D])\b"), 1)
    return F.coalesce(F.nullif(F.upper(said), F.lit("")), F.when(F.size(alone) > 0, F.element_at(alone, -1)))
