"""Morphology from distribution: edges, affixes, classes, allomorphy, segmentation, parsing."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from morphloom.session import materialise


def edges(words: DataFrame, keys: list[str], word: str, longest: int = 5, stem: int = 3, shortest: int = 1) -> DataFrame:
    """(keys, word, side, affix, stem): every split of a word into an edge and the rest.

    side is prefix or suffix; the edge has ``shortest`` to ``longest`` characters,
    the rest at least ``stem``.
    """
    size = F.length(word)
    lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), size - stem))
    cut = words.filter(size >= stem + shortest).withColumn("__cut", F.explode(lengths))
    prefix = F.struct(F.lit("prefix").alias("side"), F.expr(f"left({word}, __cut)").alias("affix"), F.expr(f"substr({word}, __cut + 1)").alias("stem"))
    suffix = F.struct(F.lit("suffix").alias("side"), F.expr(f"right({word}, __cut)").alias("affix"), F.expr(f"left({word}, length({word}) - __cut)").alias("stem"))
    kept = [c for c in words.columns if c not in (*keys, word)]
    return cut.withColumn("e", F.explode(F.array(prefix, suffix))).select(*keys, F.col(word).alias("word"), *kept, "e.side", "e.affix", "e.stem")


def attested_affixes(words: DataFrame, keys: list[str], word: str, stems: int = 10, shortest: int = 2, longest: int = 5) -> DataFrame:
    """(keys, side, affix, stems): edges whose rest is a word itself, with at least so many different rests."""
    split = edges(words.select(*keys, word).distinct(), keys, word, longest, 1, shortest)
    known = words.select(*keys, F.col(word).alias("stem")).distinct()
    return split.join(known, [*keys, "stem"], "left_semi").groupBy(*keys, "side", "affix").agg(F.countDistinct("stem").alias("stems")).filter(F.col("stems") >= stems)


def signature_affixes(words: DataFrame, keys: list[str], word: str, stems: int = 12, longest: int = 5, stem: int = 3) -> DataFrame:
    """(keys, side, affix, stems): edges on stems that are words themselves or take two edges of the side, at least so many."""
    vocabulary = words.select(*keys, word).distinct()
    split = edges(vocabulary, keys, word, longest, stem).select(*keys, "side", "affix", "stem").distinct()
    shared = split.groupBy(*keys, "side", "stem").agg(F.count(F.lit(1)).alias("fan"))
    free = vocabulary.select(*keys, F.col(word).alias("stem"), F.lit(True).alias("free"))
    good = split.join(shared, [*keys, "side", "stem"]).join(free, [*keys, "stem"], "left").filter(F.col("free").isNotNull() | (F.col("fan") >= 2))
    return good.groupBy(*keys, "side", "affix").agg(F.count(F.lit(1)).alias("stems")).filter(F.col("stems") >= stems)


def longest_edge(words: DataFrame, keys: list[str], word: str, affixes: DataFrame, side: str, stem: int = 2, longest: int = 6) -> DataFrame:
    """(keys, word, affix, stem): the longest known edge of each word that has one. affixes: (keys, affix)."""
    split = edges(words.select(*keys, word).distinct(), keys, word, longest, stem).filter(F.col("side") == side)
    known = split.join(affixes.select(*keys, "affix").distinct(), [*keys, "affix"])
    order = Window.partitionBy(*keys, "word").orderBy(F.length("affix").desc())
    return known.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*keys, "word", "affix", "stem")


def affix_candidates(words: DataFrame, roots: DataFrame, keys: list[str], longest: int = 4, root: int = 3) -> DataFrame:
    """(keys, side, residue, n): what is left of words beside their longest known root at an edge, by token frequency.

    words: (keys, word, n). A residue longer than ``longest`` blocks shorter roots
    of the same word and side, as the longest root decides.
    """
    size = F.length("word")
    cut = words.filter(size > root).withColumn("__cut", F.explode(F.sequence(F.lit(root), size - 1)))
    left = F.struct(F.lit("suffix").alias("side"), F.expr("left(word, __cut)").alias("root"), F.expr("substr(word, __cut + 1)").alias("residue"))
    right = F.struct(F.lit("prefix").alias("side"), F.expr("right(word, __cut)").alias("root"), F.expr("left(word, length(word) - __cut)").alias("residue"))
    split = cut.withColumn("e", F.explode(F.array(left, right))).select(*keys, "word", "n", "e.side", "e.root", "e.residue")
    known = split.join(roots.select(*keys, "root").distinct(), [*keys, "root"])
    order = Window.partitionBy(*keys, "word", "side").orderBy(F.length("root").desc())
    best = known.withColumn("__k", F.row_number().over(order)).filter("__k = 1").filter(F.length("residue") <= longest)
    return best.groupBy(*keys, "side", "residue").agg(F.sum("n").alias("n"))


def open_residues(words: DataFrame, roots: DataFrame, affixes: DataFrame, keys: list[str], longest: int = 4, root: int = 3, vowels: str = "aeiouáéíóú") -> DataFrame:
    """(keys, side, residue, n): what is left of words beside or inside their longest known root, without known affixes, by token frequency.

    words: (keys, word, n), roots: (keys, root), affixes: (keys, side, residue).
    side is suffix, prefix or infix, in this order for roots of one length. An
    infix of two or three characters stands behind the first consonant of a root
    of at least four. The longest root decides over all sides, whether its
    residue is of a length to be counted or not.
    """
    size = F.length("word")
    cut = words.filter(size > root).withColumn("__cut", F.explode(F.sequence(F.lit(root), size - 1)))
    split = lambda rank, side, base, rest: F.struct(F.lit(rank).alias("rank"), F.lit(side).alias("side"), F.expr(base).alias("root"), F.expr(rest).alias("residue"))
    inside = (F.col("__cut") >= 4) & (F.instr(F.lit(vowels), F.expr("left(word, 1)")) == 0)
    options = F.array(
        split(0, "suffix", "left(word, __cut)", "substr(word, __cut + 1)"),
        split(1, "prefix", "right(word, __cut)", "left(word, length(word) - __cut)"),
        F.when(inside, split(2, "infix", "concat(left(word, 1), right(word, __cut - 1))", "substr(word, 2, length(word) - __cut)")),
    )
    known = cut.withColumn("e", F.explode(F.array_compact(options))).select(*keys, "word", "n", "e.*").join(roots.select(*keys, "root").distinct(), [*keys, "root"])
    order = Window.partitionBy(*keys, "word").orderBy(F.length("root").desc(), "rank")
    best = known.withColumn("__k", F.row_number().over(order)).filter("__k = 1")
    fits = F.when(F.col("side") == "infix", F.length("residue").between(2, 3)).otherwise(F.length("residue") <= longest)
    return best.filter(fits).join(affixes.select(*keys, "side", "residue").distinct(), [*keys, "side", "residue"], "left_anti").groupBy(*keys, "side", "residue").agg(F.sum("n").alias("n"))


def skeleton(form: Column, vowels: str = "aeiouáéíóú") -> Column:
    """A form without its vowels."""
    return F.translate(form, vowels, "")


def harmony_families(affixes: DataFrame, keys: list[str], form: str = "form") -> DataFrame:
    """(keys, skeleton, forms, members): forms that differ in vowels only, two at least; members are joined by blanks."""
    named = affixes.filter(F.col(form).isNotNull()).withColumn("skeleton", skeleton(F.col(form)))
    grouped = named.groupBy(*keys, "skeleton").agg(F.array_sort(F.collect_set(form)).alias("__m"))
    return grouped.filter(F.size("__m") >= 2).select(*keys, "skeleton", F.size("__m").cast("bigint").alias("forms"), F.array_join("__m", " ").alias("members"))


def stem_classes(split: DataFrame, keys: list[str], signatures: int = 2, stems: int = 8) -> DataFrame:
    """(keys, signature, stems): sets of edges that at least so many stems share, of stems with at least two edges.

    split: (keys, stem, side, affix).
    """
    marks = F.concat(F.when(F.col("side") == "prefix", F.concat("affix", F.lit("-"))).otherwise(F.concat(F.lit("-"), "affix")))
    sets = split.groupBy(*keys, "stem").agg(F.array_sort(F.collect_set(marks)).alias("__s")).filter(F.size("__s") >= signatures)
    return sets.groupBy(*keys, F.array_join("__s", " ").alias("signature")).agg(F.count(F.lit(1)).alias("stems")).filter(F.col("stems") >= stems)


def near_forms(forms: DataFrame, keys: list[str], form: str = "form") -> DataFrame:
    """(keys, left, right): forms one edit apart, left < right.

    Two forms within one edit share the form itself or the form without one
    character, so candidates meet in an equi-join on those keys; the distance
    then decides.
    """
    distinct = forms.select(*keys, F.col(form).alias("f")).filter(F.col("f").isNotNull() & (F.col("f") != "")).distinct()
    without = F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.concat(F.substr("f", F.lit(1), i - 1), F.substr("f", i + 1)))
    keyed = distinct.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("f"), without))))
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, "key")]
    pairs = keyed.alias("x").join(keyed.alias("y"), same).filter(F.col("x.f") < F.col("y.f"))
    pairs = pairs.select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.f").alias("left"), F.col("y.f").alias("right")).distinct()
    return pairs.filter(F.levenshtein("left", "right") == 1)


def environments(df: DataFrame, keys: list[str], row: list[str], position: str, form: str, least: int = 8, vowels: str = "aeiou") -> DataFrame:
    """(keys, form, dimension, bucket, n): what stands beside the forms of morphs, as vowel, consonant or word edge.

    dimension is right or left; only forms with at least ``least`` occurrences.
    """
    order = Window.partitionBy(*keys, *row).orderBy(position)

    def kind(neighbour: Column, at: str) -> Column:
        letter = F.expr(f"{at}(__w, 1)")
        return F.when(neighbour.isNull(), "#").when(F.translate(F.lower(letter), vowels, "") == "", "V").otherwise("C")

    seen = df.withColumn("__after", F.lead(form).over(order)).withColumn("__before", F.lag(form).over(order))
    right = seen.withColumn("__w", F.col("__after")).select(*keys, F.col(form).alias("form"), F.lit("right").alias("dimension"), kind(F.col("__after"), "left").alias("bucket"))
    left = seen.withColumn("__w", F.col("__before")).select(*keys, F.col(form).alias("form"), F.lit("left").alias("dimension"), kind(F.col("__before"), "right").alias("bucket"))
    counted = right.unionByName(left).groupBy(*keys, "form", "dimension", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "form", "dimension"))
    return counted.withColumn("__t", total).filter(F.col("__t") >= least).drop("__t")


def slot_order(morphs: DataFrame, keys: list[str], form: str, kind: str, slot: str, least: int = 2) -> DataFrame:
    """(keys, form, kind, slot, n): each affix's most frequent slot; ties go to the lower one."""
    counted = morphs.groupBy(*keys, form, kind, slot).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, form, kind).orderBy(F.desc("n"), F.asc(slot))
    return counted.withColumn("__k", F.row_number().over(order)).filter((F.col("__k") == 1) & (F.col("n") >= least)).drop("__k")


# --- segmentation and parsing: bounded search inside a word, behind a distinct -----------------------------------


def analyses_of(word: str, roots: dict[str, list[str]], prefixes: dict[str, list[str]], suffixes: dict[str, list[str]], depth: int = 4) -> set[tuple[tuple[str, str], ...]]:
    """Every reading of a word as prefixes, one root, suffixes: tuples of (form, gloss) in the order of the surface.

    Each affix at most once on its side, at most ``depth`` on a side, a root of at
    least one character.
    """
    ends: list[tuple[int, tuple[tuple[str, str], ...]]] = []

    def left(start: int, taken: tuple[tuple[str, str], ...]) -> None:
        ends.append((start, taken))
        if len(taken) < depth:
            for stop in range(start + 1, len(word)):
                for gloss in prefixes.get(word[start:stop], ()):
                    if (word[start:stop], gloss) not in taken:
                        left(stop, (*taken, (word[start:stop], gloss)))

    left(0, ())
    out: set[tuple[tuple[str, str], ...]] = set()

    def right(at: int, start: int, taken: tuple[tuple[str, str], ...], front: tuple[tuple[str, str], ...]) -> None:
        for gloss in roots.get(word[start:at], ()):
            out.add((*front, (word[start:at], gloss), *taken))
        if len(taken) < depth:
            for begin in range(start + 1, at):
                for gloss in suffixes.get(word[begin:at], ()):
                    if (word[begin:at], gloss) not in taken:
                        right(begin, start, ((word[begin:at], gloss), *taken), front)

    for start, front in ends:
        right(len(word), start, (), front)
    return out


def parse_words(words: DataFrame, space: str, word: str, roots: DataFrame, affixes: DataFrame, depth: int = 4) -> DataFrame:
    """(space, word, analysis, line, forms): the readings of each distinct word under its space's grammar.

    roots: (space, form, gloss), affixes: (space, form, gloss, kind). line is the
    glosses and forms the morphs, joined by ``-``; analysis numbers a word's
    distinct lines from 1 in ascending order. Words without reading give no row.

    Only the parts of the grammar that can occur in a word reach it: the word's
    substrings are joined with roots and affixes, so a lexicon of any size is
    never broadcast, and a parser call sees a few candidates.
    """
    distinct = words.select(F.col(space).alias("space"), F.col(word).alias("word")).filter(F.col("word").isNotNull() & (F.col("word") != "")).distinct()
    size = F.length("word")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: F.substr("word", i, j - i + 1)))
    )
    parts = distinct.withColumn("part", F.explode(F.array_distinct(spans)))
    grammar = roots.select(F.col("space"), F.col("form").alias("part"), "gloss", F.lit("root").alias("kind")).unionByName(
        affixes.select(F.col("space"), F.col("form").alias("part"), "gloss", "kind")
    )
    grammar = grammar.filter(F.col("part").isNotNull()).withColumn("gloss", F.coalesce("gloss", F.lit("?"))).distinct()
    found = parts.join(grammar, ["space", "part"]).groupBy("space", "word").agg(F.collect_list(F.struct("part", "gloss", "kind")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, lines, forms = [], [], [], []
            for i, (text, items) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                tables: dict[str, dict[str, list[str]]] = {"root": {}, "prefix": {}, "suffix": {}}
                for item in items.as_py():
                    if item["kind"] in tables:
                        tables[item["kind"]].setdefault(item["part"], []).append(item["gloss"])
                readings = analyses_of(text.as_py(), tables["root"], tables["prefix"], tables["suffix"], depth)
                rows = sorted({("-".join(g for _, g in r), "-".join(f for f, _ in r)) for r in readings})
                for number, (line, form) in enumerate(rows, 1):
                    at.append(i)
                    numbers.append(number)
                    lines.append(line)
                    forms.append(form)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), pa.array(forms, pa.string())],
                names=["space", "word", "analysis", "line", "forms"],
            )

    return found.mapInArrow(run, "space string, word string, analysis bigint, line string, forms string")


#: The mark of a word's end; it never occurs in a word.
WORD_END = "▁"


def learn_merges(words: DataFrame, merges: int) -> list[tuple[str, str]]:
    """The most frequent pairs of neighbouring symbols, merged one after the other; words: (word, n).

    Ties go to the smallest pair. Stops below a frequency of 2. The driver holds
    the merges only; symbols are rewritten where the words are, and written to
    the shared folder every few merges so that the lineage stays short.
    """
    state = words.filter(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.sum("n").alias("n"))
    state = materialise(state.withColumn("symbols", F.concat(F.regexp_extract_all("word", F.lit("(?s)."), 0), F.array(F.lit(WORD_END)))), "merges")
    done: list[tuple[str, str]] = []
    for step in range(merges):
        pairs = state.filter(F.size("symbols") > 1).select("n", F.explode(F.arrays_zip(F.slice("symbols", F.lit(1), F.size("symbols") - 1).alias("a"), F.slice("symbols", F.lit(2), F.size("symbols")).alias("b"))).alias("p"))
        best = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(1).collect()
        if not best or best[0]["n"] < 2:
            break
        a, b = best[0]["a"], best[0]["b"]
        done.append((a, b))
        state = state.withColumn("symbols", merge_symbols(F.col("symbols"), a, b))
        if step % 4 == 3:
            state = materialise(state, "merges")
    return done


def merged_words(words: DataFrame, keys: list[str], merges: int) -> DataFrame:
    """(keys, word, symbols): each key's words after the merges learned from them; words: (keys, word, n), a word once a key.

    The same merges, in the same order, as ``learn_merges`` finds in the words of
    one key. Each key is learned by itself, and a merge rewrites only the words
    that have its pair, so the number of merges costs little; one key's distinct
    words have to fit a worker.
    """

    def learn(frame):
        names, counts = list(frame["word"]), [int(n) for n in frame["n"]]
        split = [[*w, WORD_END] for w in names]
        total, where = Counter(), {}
        for i, symbols in enumerate(split):
            for pair in zip(symbols, symbols[1:], strict=False):
                total[pair] += counts[i]
                where.setdefault(pair, set()).add(i)
        heap = [(-n, pair) for pair, n in total.items()]
        heapq.heapify(heap)
        done = 0
        while heap and done < merges:
            n, pair = heapq.heappop(heap)
            if -n != total[pair]:
                continue
            if -n < 2:
                break
            done += 1
            changed = set()
            for i in where.pop(pair):
                old, new = split[i], []
                for x in old:
                    if new and (new[-1], x) == pair:
                        new[-1] += x
                    else:
                        new.append(x)
                split[i] = new
                for sign, symbols in ((-1, old), (1, new)):
                    for p in zip(symbols, symbols[1:], strict=False):
                        total[p] += sign * counts[i]
                        changed.add(p)
                        if sign > 0:
                            where.setdefault(p, set()).add(i)
            for p in changed:
                if total[p] > 0:
                    heapq.heappush(heap, (-total[p], p))
        split = [unmarked(x) for x in split]
        out = {k: [frame[k].iat[0]] * len(names) for k in keys}
        return pd.DataFrame({**out, "word": names, "symbols": split}, dtype=object)

    named = words.filter(F.col("word").isNotNull()).select(*keys, "word", "n")
    kept = StructType([*named.select(*keys, "word").schema, StructField("symbols", ArrayType(StringType()))])
    return named.groupBy(*keys).applyInPandas(learn, kept)


def merge_symbols(symbols: Column, a: str, b: str) -> Column:
    """Symbols with each ``a`` before a ``b`` joined to it, from left to right."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1) == a) & (x == b),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.lit(a + b))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(symbols, F.array().cast("array<string>"), step)


class _Joined(str):
    """A symbol that this merge has made; it is not merged again by it."""


def unmarked(symbols: list[str]) -> list[str]:
    """Symbols without the mark of the word's end."""
    last = symbols[-1].removesuffix(WORD_END)
    return symbols[:-1] + ([last] if last else [])


def apply_merges(word: Column, merges: list[tuple[str, str]]) -> Column:
    """The symbols of a word after the merges, in the order they were learned."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(words: pd.Series) -> pd.Series:
        made: dict[str, list[str]] = {}

        def one(text: str) -> list[str]:
            symbols = [*text, WORD_END]
            for a, b in merges:
                if a in symbols and b in symbols:
                    new: list[str] = []
                    for x in symbols:
                        if x == b and new and new[-1] == a and not isinstance(new[-1], _Joined):
                            new[-1] = _Joined(a + b)
                        else:
                            new.append(x)
                    symbols = [str(x) for x in new]
            return unmarked(symbols)

        for w in words.dropna().unique():
            made[w] = one(w)
        return words.map(lambda w: made.get(w))

    return split(word)
