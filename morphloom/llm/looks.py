"""Visually identical text with different characters (problem 4).

A text's *look* is its one consistent form: composed letters of one script in
ordinary width and style, single U+0020 between words, U+002D as hyphen, U+02BC
as glottal letter, nothing invisible. Most text is already so. Characters that
no step of the conversion can change, alone or together with their neighbours,
are *stable*: normalization's quick check says Yes for NFC and for the
compatibility form, they have combining class 0, and they are no look-alike.
Only maximal runs of other characters, with the stable character before them as
boundary context (a mark may compose with it), are converted; the results are
spliced into the unchanged rest. A text without such a run is passed through in
the JVM by one regular expression and never reaches Python.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alikes of the letters of a script, from other scripts or styles that
# compatibility normalization does not fold. Each pair is the letter and what looks like it.
LATIN = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄⅽ", "d": "ԁⅾ", "e": "еҽ℮", "f": "ẝ", "g": "ɡցᶃ", "h": "һհ", "i": "іιɩꙇı", "j": "јϳ",
    "k": "ĸ", "l": "ӏⅼǀ", "m": "ⅿ", "n": "ոռ", "o": "оοօσᴏ", "p": "рρ", "q": "ԛգ", "r": "ᴦꭇ", "s": "ѕꜱ", "t": "τ", "u": "սυꞟᴜ",
    "v": "νѵᴠⅴ", "w": "ԝաᴡ", "x": "хⅹ", "y": "уγყ", "z": "ᴢ", "ɛ": "εԑ", "ŋ": "ղ", "ɔ": "ͻᴐ", "ə": "ә", "æ": "ӕ",
    "A": "АΑᎪ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "L": "Ꮮ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
CYRILLIC = {
    "а": "aɑα", "в": "ʙ", "г": "ᴦ", "е": "e℮ҽ", "и": "ᴎ", "к": "ĸκᴋ", "л": "ᴫ", "м": "ᴍ", "н": "ʜ", "о": "oοօσᴏ", "п": "ᴨπ", "р": "pρ",
    "с": "cϲᴄⅽ", "т": "ᴛ", "у": "yγყ", "ф": "ɸ", "х": "xⅹ", "э": "϶", "я": "ᴙ", "і": "iι", "ј": "jϳ", "ѕ": "sꜱ", "һ": "hհ", "ԁ": "dⅾ", "ԝ": "w", "ԛ": "q",
    "А": "AΑ", "В": "BΒ", "Е": "EΕ", "К": "KΚ", "М": "MΜ", "Н": "HΗ", "О": "OΟՕ", "Р": "PΡ", "С": "CϹ", "Т": "TΤ", "У": "YΥ", "Х": "XΧ", "Г": "Γ", "П": "Π", "Ф": "Φ", "І": "IΙ", "Ј": "J", "Ѕ": "S",
}
GLOTTAL = "'`´‘’‛ʹʻʽˈˊʾ′‵ꞌՙ＇ʼ᾽᾿ʼ"
HYPHENS = "‐‑‒–−⁃˗﹣－֊᠆"
BLANKS = "⠀"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"

SCRIPTS = {"Latn": LATIN, "Cyrl": CYRILLIC}


def shows_nothing(ch: str) -> bool:
    """Whether a character leaves no mark and takes no room: format signs, fillers, variation selectors, controls."""
    kind = unicodedata.category(ch)
    if kind == "Cc":
        return not ch.isspace()
    return kind == "Cf" or ch in INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or "᠋" <= ch <= "᠏"


@lru_cache(maxsize=None)
def lookalikes(script: str) -> dict[str, str]:
    """Character -> the letter of the script, or sign, that it looks like; signs alone for a script without table."""
    table = {alike: letter for letter, all_alike in SCRIPTS.get(script, {}).items() for alike in all_alike if alike != letter}
    return table | {g: "ʼ" for g in GLOTTAL if g != "ʼ"} | {h: "-" for h in HYPHENS}


def canonical(segment: str, script: str) -> str:
    """The look of a segment: every step applied to every character."""
    table = lookalikes(script)
    kept = "".join(table.get(c, c) if c in GLOTTAL or c in HYPHENS else c for c in segment if not shows_nothing(c))
    apart = unicodedata.normalize("NFKD", "".join(" " if c.isspace() or c in BLANKS else c for c in kept))
    mapped = "".join(table.get(c, c) for c in apart)
    mapped = re.sub("i̇", "i", mapped) if script == "Latn" else mapped
    return re.sub(" +", " ", unicodedata.normalize("NFC", mapped))


@lru_cache(maxsize=1 << 16)
def is_stable(ch: str, script: str) -> bool:
    """Whether no step can change ``ch``, whatever stands beside it."""
    if ch == " ":
        return False  # blanks are trimmed and joined, so they need their context
    return (
        unicodedata.combining(ch) == 0
        and unicodedata.is_normalized("NFC", ch)
        and unicodedata.is_normalized("NFKC", ch)
        and unicodedata.category(ch)[0] != "M"
        and not ch.isspace()
        and not shows_nothing(ch)
        and ch not in BLANKS
        and canonical(ch, script) == ch
        and not 0x1100 <= ord(ch) <= 0x11FF
    )


@lru_cache(maxsize=None)
def _ranges(script: str) -> str:
    """The stable characters below U+0600 as a regular expression's ranges."""
    out, start = [], None
    for code in range(0x600 + 1):
        stable = code < 0x600 and unicodedata.category(chr(code)) != "Cn" and is_stable(chr(code), script)
        if stable and start is None:
            start = code
        elif not stable and start is not None:
            out.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    return "".join(out)


def look(text: str, script: str) -> str:
    """The look of a text: unstable runs converted with their boundary context, the rest as it is."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        j = i
        while j < n and is_stable(text[j], script):
            j += 1
        if j == n:
            out.append(text[i:])
            break
        k = j
        while k < n and not is_stable(text[k], script):
            k += 1
        start = j - 1 if j > i else j
        out.append(text[i:start])
        out.append(canonical(text[start:k], script))
        i = k
    made = "".join(out)
    return made.strip(" ")


def with_look(df: DataFrame, text: str, script: str, name: str = "look") -> DataFrame:
    """``df`` with the look of column ``text`` under the script named in column ``script``.

    Null text gives null; an empty text gives an empty one. Under a null script or
    one without table of look-alikes, everything but look-alike letters is brought
    to one form.
    """
    quick: Column = F.lit(False)
    known = F.coalesce(F.col(script).isin(list(SCRIPTS)), F.lit(False))
    for one in (*SCRIPTS, ""):
        ranges = _ranges(one)
        meant = F.col(script).eqNullSafe(F.lit(one)) if one else ~known
        quick = quick | (meant & F.col(text).rlike(f"^[{ranges}]*( [{ranges}]+)*\\z") & ~F.col(text).startswith(" "))

    @F.pandas_udf("string")
    def convert(texts: pd.Series, scripts: pd.Series) -> pd.Series:
        return pd.Series([look(t, s if s in SCRIPTS else "") if isinstance(t, str) else None for t, s in zip(texts, scripts, strict=True)], dtype=object)

    slow = F.when(F.col(text).isNotNull() & ~quick, F.col(text))
    return df.withColumn(name, F.when(F.col(text).isNotNull() & quick, F.col(text)).otherwise(convert(slow, F.col(script))))


def lead_back(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(tab, row_id, entry_id): rows that look like a plain entry but are stored otherwise.

    rows: (tab, row_id, pair, text, look); entries: (entry_id, pair, text, look).
    A plain entry is one that equals its own look; of several with one look the
    smallest entry_id counts. Rows that repeat give one result.
    """
    plain = entries.filter(F.col("text") == F.col("look")).groupBy("pair", "look").agg(F.min("entry_id").alias("entry_id"))
    other = rows.filter(F.col("text") != F.col("look")).select("tab", "row_id", "pair", "look").distinct()
    return other.join(plain, ["pair", "look"]).select("tab", "row_id", "entry_id")
