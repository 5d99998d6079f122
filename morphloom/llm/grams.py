"""Words and sentences of many texts at once, as arrays of code points.

A group of texts is one array of code points. Every step (folding, joining of
spelled-out words, sentences, words, hashes of words) is a pass over that array,
so the work a character costs does not depend on Python. What a code point
becomes and is, is worked out when it is first met and kept in tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from morphloom.llm.looks import lookalikes, shows_nothing

#: A noncharacter that stands between the texts of a group; in a text it counts as a blank.
EDGE = "￿"
#: Characters that are worked on at once, unless one text has more.
GROUP = 1 << 20

ALNUM, LETTER, INNER, TRAIL, SEPARATOR, SPACE, STOP, CLOSING, MARK, SPAN, LINE, VOWEL, PLAIN = (1 << i for i in range(13))
# The signs of each class.
SIGNS = {
    INNER: "!@$|*€+£¡'’_.-·~", TRAIL: "$!@", SEPARATOR: " _.-*·~", STOP: ".!?…", CLOSING: "\"”»“’)", MARK: "„“«‹\"”»›", SPAN: "„“«‹\"”»›‘’",
    LINE: "\r\n  \x85" + EDGE, VOWEL: "aeiouy*", PLAIN: "abcdefghijklmnopqrstuvwxyz",
}
CLOSERS = {"„": "“”", "“": "”", "«": "»", "‹": "›", '"': '"', "‘": "’"}
# Signs that stand for letters inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t", "£": "l", "¡": "i"})
LONG = re.compile(r"(.)\1{2,}")
WIDE = {a: b for a, b in lookalikes("Latn").items() if b.isascii() and b.isalpha()}

UNMET, MANY = -1, -2
_FOLD = np.full(0x110000, UNMET, np.int32)
_CLASS = np.zeros(0x110000, np.uint16)
_LONGER: dict[int, str] = {}


def _folded(ch: str) -> str:
    """A character in lower case, compatibility form, without accents; nothing for one that shows nothing."""
    if shows_nothing(ch):
        return ""
    if "가" <= ch <= "힣":
        return ch
    apart = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return "".join(c for c in unicodedata.normalize("NFKD", apart.casefold()) if not unicodedata.combining(c))


def _meet(code: int) -> None:
    text = _folded(chr(code)) if code != ord(EDGE) else EDGE
    if len(text) > 1:
        _FOLD[code], _LONGER[code] = MANY, text
        return
    _FOLD[code] = ord(text) if text else 0
    if text:
        kind = (ALNUM if text.isalnum() else 0) | (LETTER if text.isalnum() and not text.isdecimal() else 0) | (SPACE if text.isspace() else 0)
        _CLASS[ord(text)] = kind | sum(flag for flag, signs in SIGNS.items() if text in signs)


def fold(text: str) -> np.ndarray:
    """The folded code points of a text."""
    while True:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = _FOLD[raw]
        odd = out < 0
        if not odd.any():
            return out[out > 0]
        codes = np.unique(raw[odd]).tolist()
        for code in codes:
            if _FOLD[code] == UNMET:
                _meet(code)
        for code in codes:
            if _FOLD[code] == MANY:
                text = text.replace(chr(code), _LONGER[code])


def word(token: str) -> str:
    """One form for the spellings of a folded word."""
    if token[0].isdigit() and not any(c.isalpha() for c in token):
        return "#"
    if not token.isascii() and (any("a" <= c <= "z" for c in token) or all(c in WIDE or c.isascii() for c in token)):
        token = "".join(WIDE.get(c, c) for c in token)
    if not token.isalpha():
        token = re.sub(r"['’_.\-·~]", "", token.translate(LEET))
    return LONG.sub(r"\1", token)


BASE, K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums, modulo 2^64, of the runs of ``values`` that end at ``ends``."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    at = total[ends]
    return at - np.concatenate([np.zeros(1, np.uint64), at[:-1]])


def _stir(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * K2 + np.uint64(salt)
    return (h ^ (h >> np.uint64(29))) * K3


def hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word, given as runs of code points: hashes of itself, of its consonants, and of its letters in any order."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        first = ends - sizes
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, BASE, np.uint64), dtype=np.uint64)
        values = (codes.astype(np.uint64) + np.uint64(1)) * K1
        values ^= values >> np.uint64(31)
        rank = np.arange(len(codes)) - np.repeat(first, sizes)
        whole, letters = _sums(values * powers[rank], ends), _sums(values * values, ends)
        bare = np.flatnonzero((_CLASS[codes] & VOWEL) == 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)[bare]
        kept = np.ones(len(bare), bool)
        kept[1:] = (codes[bare][1:] != codes[bare][:-1]) | (owner[1:] != owner[:-1])
        bare, owner = bare[kept], owner[kept]
        count = np.bincount(owner, minlength=len(sizes))
        stops = np.cumsum(count)
        place = np.arange(len(bare)) - np.repeat(stops - count, count)
        return np.stack([_stir(whole, 1), _stir(_sums(values[bare] * powers[place], stops), 2), _stir(letters, 3)], 1)


def hashes_of(words: list[str]) -> np.ndarray:
    """``hashes`` of words given as strings."""
    sizes = np.array([len(w) for w in words], np.int64)
    return hashes(fold_table("".join(words)), sizes)


def fold_table(text: str) -> np.ndarray:
    """The code points of a text that is folded already; their classes are made known."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for code in np.unique(codes[_FOLD[codes] == UNMET]).tolist():
        _meet(code)
    return codes.astype(np.int64)


class Words(NamedTuple):
    """The words of a group of texts.

    codes: all folded code points. starts: where each word starts. hashes: three of
    each word. at: its sentence, counted over sentences with words. owner: the text
    of each sentence. bounds: where each sentence starts and ends. marks, marks_at:
    quotation marks in sentences with words, and their sentence.
    """

    codes: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray
    marks: np.ndarray
    marks_at: np.ndarray

    def text(self, sentence: int) -> str:
        """A sentence in folded spelling."""
        low, high = self.bounds[sentence]
        return "".join(map(chr, self.codes[low:high].tolist())).strip()


def _join_spelled(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which code points stay when letters that stand one by one, three or more, with one or two separators between them, become a word."""
    keep = np.ones(len(codes), bool)
    alnum = np.concatenate([[False], (kind & ALNUM) > 0, [False]])
    single = np.flatnonzero(((kind & LETTER) > 0) & ~alnum[:-2] & ~alnum[2:])
    if len(single) < 3:
        return keep
    between, gap = (kind & SEPARATOR) > 0, np.diff(single)
    link = ((gap == 2) | (gap == 3)) & between[single[:-1] + 1] & ((gap == 2) | between[np.minimum(single[:-1] + 2, len(codes) - 1)])
    wide = np.concatenate([[False], link, [False]])
    chained = link & (wide[:-2] | wide[2:])
    at, two = single[:-1][chained], gap[chained] == 3
    keep[at + 1] = False
    keep[at[two] + 2] = False
    return keep


def _quoted_spans(codes: np.ndarray, kind: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of quotations that are closed in their line. Visits quotation marks only, each a bounded number of times."""
    at = np.flatnonzero(kind & SPAN)
    signs, line = [chr(c) for c in codes[at].tolist()], np.searchsorted(lines, at).tolist()
    low, high, open_in = [], [], {}
    i, n = 0, len(signs)
    while i < n:
        closers = CLOSERS.get(signs[i])
        if closers and open_in.get(signs[i]) != line[i]:
            j = i + 1
            while j < n and line[j] == line[i] and signs[j] not in closers:
                j += 1
            if j < n and line[j] == line[i]:
                low.append(at[i])
                high.append(at[j])
                i = j
            else:
                open_in[signs[i]] = line[i]
        i += 1
    return np.array(low, np.int64), np.array(high, np.int64)


def _breaks(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where sentences end: at the ends of lines and texts, and at blanks after a stop (and a closing sign), unless inside a closed quotation."""
    lines = np.flatnonzero(kind & LINE)
    stop, closing, blank = (kind & STOP) > 0, (kind & CLOSING) > 0, (kind & SPACE) > 0
    after = np.zeros(len(codes), bool)
    after[1:] = stop[:-1]
    after[2:] |= closing[1:-1] & stop[:-2]
    at = np.flatnonzero(blank & after & ((kind & LINE) == 0))
    low, high = _quoted_spans(codes, kind, lines)
    if len(low) and len(at):
        k = np.searchsorted(low, at, "right") - 1
        at = at[(k < 0) | (at > high[k])]
    return np.union1d(lines, at)


def words_of(texts: list[str | None]) -> Words:
    """The words of whole texts; a null text has none."""
    codes = fold(EDGE.join((t or "").replace(EDGE, " ") for t in texts))
    kind = _CLASS[codes]
    keep = _join_spelled(codes, kind)
    if not keep.all():
        codes, kind = codes[keep], kind[keep]
    alnum = np.flatnonzero(kind & ALNUM)
    run = np.cumsum((kind & (ALNUM | INNER)) == 0)[alnum]
    new = np.flatnonzero(np.diff(run, prepend=-1))
    starts, ends = alnum[new], (alnum[np.append(new[1:], len(alnum)) - 1] + 1 if len(new) else alnum)
    trailing = np.flatnonzero(np.append((kind & TRAIL) > 0, False)[ends])
    if len(trailing):
        other = np.append(np.flatnonzero((kind & TRAIL) == 0), len(codes))
        ends[trailing] = other[np.searchsorted(other, ends[trailing])]
    breaks = _breaks(codes, kind)
    rough = np.searchsorted(breaks, starts)
    new = np.flatnonzero(np.diff(rough, prepend=-1))
    at = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(rough))))
    numbers = rough[new]
    edges = np.concatenate([[-1], breaks, [len(codes)]])
    bounds = np.stack([edges[numbers] + 1, edges[numbers + 1]], 1)
    owner = np.searchsorted(np.flatnonzero(codes == ord(EDGE)), starts[new])
    marks = np.flatnonzero(kind & MARK)
    held = np.searchsorted(breaks, marks)
    place = np.searchsorted(numbers, held)
    inside = np.append(numbers, -1)[place] == held
    return Words(codes, starts, _hashed(codes, kind, starts, ends), at, owner, bounds, marks[inside], place[inside])


#: Hashes of forms by the hash of the word as it stands, for words that are not of plain letters; emptied when it holds so many.
_KNOWN: dict[int, tuple[int, int, int]] = {}
REMEMBER = 200_000


def _hashed(codes: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hashes`` of each word's one form. Words of plain letters are hashed as they are, numbers alike, distinct others through ``word``."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
    chars, kinds = codes[inner], kind[inner]
    made = hashes(chars, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = (kinds & PLAIN) == 0
    odd[2:] |= (chars[2:] == chars[1:-1]) & (chars[2:] == chars[:-2]) & (owner[2:] == owner[:-2])
    slow = np.zeros(len(sizes), bool)
    slow[owner[odd]] = True
    lettered = np.zeros(len(sizes), bool)
    lettered[owner[(kinds & LETTER) > 0]] = True
    made[~lettered] = hashes_of(["#"])
    slow = np.flatnonzero(slow & lettered)
    if len(slow):
        ids, some, which = np.unique(made[slow, 0], return_index=True, return_inverse=True)
        keys = ids.tolist()
        new = [i for i, key in enumerate(keys) if key not in _KNOWN]
        forms = hashes_of([word("".join(map(chr, codes[starts[i] : ends[i]].tolist()))) for i in slow[some[new]].tolist()]) if new else []
        fresh = dict(zip([keys[i] for i in new], map(tuple, forms), strict=True))
        rows = [fresh.get(key) or _KNOWN[key] for key in keys]
        made[slow] = np.array(rows, np.uint64)[which]
        if len(_KNOWN) + len(fresh) > REMEMBER:
            _KNOWN.clear()
        _KNOWN.update(fresh)
    return made


def groups(texts: list[str | None], size: int = GROUP) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts): consecutive texts of about ``size`` characters together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
