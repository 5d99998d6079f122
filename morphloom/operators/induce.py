"""Induction in rounds: peeling, growing roots, labelling affixes, guided splits, co-training, and what is left unexplained."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.functions.text import reduplicated, vowel_groups
from morphloom.operators import align, assess, morph
from morphloom.operators.gold import english_inflection
from morphloom.session import materialise

# Places of articulation.
PLACES = {"labial": "pbmfvw", "coronal": "tdnszlrj", "dorsal": "kgxŋqh"}


def peel(words: DataFrame, known: DataFrame, affixes: DataFrame, keys: list[str], depth: int | None = 5, stem: int = 2, longest: int = 6) -> DataFrame:
    """(keys, word, stem, peeled, known): words after taking off known edges, the longest first, until a known word is left.

    words, known: (keys, word), affixes: (keys, side, affix). At most ``depth``
    edges, or without one as many as there are; of equally long ones the prefix
    goes. Each round is two equi-joins on the words still unexplained, and is
    written to the shared folder; the first round that moves nothing is the last.
    """
    listed = known.select(*keys, F.col("word").alias("stem")).distinct().withColumn("__known", F.lit(True))
    inventory = affixes.filter(F.col("affix") != "").select(*keys, "side", "affix").distinct()

    def judge(state: DataFrame) -> DataFrame:
        return state.join(listed, [*keys, "stem"], "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")

    state = judge(words.select(*keys, "word").distinct().withColumns({"stem": F.col("word"), "peeled": F.lit(0)}))
    state = materialise(state, "peel")
    for turn in itertools.count(1) if depth is None else range(1, depth + 1):
        open_ = state.filter(~F.col("known"))
        cut = morph.edges(open_.select(*keys, "stem").distinct(), keys, "stem", longest, stem)
        # the stem column of edges is the rest; word is what was cut
        hit = cut.join(inventory, [*keys, "side", "affix"])
        order = Window.partitionBy(*keys, "word").orderBy(F.length("affix").desc(), "side")
        best = hit.withColumn("__p", F.row_number().over(order)).filter("__p = 1").select(*keys, F.col("word").alias("stem"), F.col("stem").alias("__rest"))
        moved = state.join(best, [*keys, "stem"], "left")
        go = ~F.col("known") & F.col("__rest").isNotNull()
        state = judge(moved.select(*keys, "word", F.when(go, F.col("__rest")).otherwise(F.col("stem")).alias("stem"), (F.col("peeled") + go.cast("int")).alias("peeled")))
        state = materialise(state, "peel")
        if state.filter(F.col("peeled") == turn).limit(1).count() == 0:
            break
    return state.select(*keys, "word", "stem", "peeled", "known")


def strip_edges(words: DataFrame, affixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, rest, morphs): words after taking off edges until none fits, whether or not what is left is known.

    The longest fitting prefix goes first, then the longest fitting suffix; at
    least two characters stay, and of a rest of two nothing is taken. Affixes of a
    key are one list beside each word, so a word needs no exchange a step.
    words: (keys, word), affixes: (keys, side, affix).
    """
    length = lambda x: F.struct((-F.length(x)).alias("long"), x.alias("affix"))
    side = lambda name: F.transform(F.array_sort(F.collect_set(F.when((F.col("side") == name) & (F.col("affix") != ""), length(F.col("affix"))))), lambda x: x["affix"])
    lists = affixes.groupBy(*keys).agg(side("prefix").alias("__pre"), side("suffix").alias("__suf"))
    joined = words.select(*keys, "word").distinct().join(lists, keys, "left")
    none = F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        pre = F.get(F.filter(F.coalesce("__pre", none), lambda p: F.startswith(rest, p) & (F.length(rest) > F.length(p) + 1)), F.lit(0))
        suf = F.get(F.filter(F.coalesce("__suf", none), lambda x: F.endswith(rest, x) & (F.length(rest) > F.length(x) + 1)), F.lit(0))
        shorter = F.when(pre.isNotNull(), F.substr(rest, F.length(pre) + 1)).when(suf.isNotNull(), F.substr(rest, F.lit(1), F.length(rest) - F.length(suf)))
        goes = (F.length(rest) > 2) & shorter.isNotNull()
        return F.struct(F.when(goes, shorter).otherwise(rest).alias("rest"), (state["morphs"] + goes.cast("int")).alias("morphs"))

    start = F.struct(F.col("word").alias("rest"), F.lit(1).alias("morphs"))
    steps = F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))
    return joined.withColumn("__s", F.aggregate(steps, start, step)).select(*keys, "word", F.col("__s.rest").alias("rest"), F.col("__s.morphs").alias("morphs"))


def synthesis(vocabulary: DataFrame, stripped: DataFrame, keys: list[str], top: int = 400) -> DataFrame:
    """(keys, index, clean, type): morphs a token, the token share of words that strip to an attested stem, and the type of language.

    Counts words of letters, two at least. isolating below 1.5 morphs, or where the
    ``top`` most frequent words (50 with a vowel, at least) have fewer than 1.4 vowel
    groups and more than 0.7 of them one; from 3.5 polysynthetic, from 2.3
    agglutinative, else fusional. An attested stem is a word that stands twice.
    """
    alpha = vocabulary.filter(F.col("word").rlike(r"^\p{L}{2,}$"))
    attested = vocabulary.filter((F.col("n") >= 2) & (F.length("word") >= 2)).select(*keys, F.col("word").alias("rest"), F.lit(True).alias("__at"))
    joined = alpha.join(stripped, [*keys, "word"]).join(attested, [*keys, "rest"], "left")
    clean = F.sum(F.when((F.col("morphs") >= 2) & F.col("__at"), F.col("n")).otherwise(0)) / F.sum("n")
    index = joined.groupBy(*keys).agg((F.sum(F.col("n") * F.col("morphs")) / F.sum("n")).alias("index"), clean.alias("clean"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    often = alpha.withColumn("__p", place).filter(F.col("__p") <= top).withColumn("__v", vowel_groups(F.col("word"))).filter("__v > 0")
    short = often.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg("__v").alias("__m"), F.avg((F.col("__v") == 1).cast("int")).alias("__one"))
    flagged = index.join(short, keys, "left")
    one = F.coalesce((F.col("__n") >= 50) & (F.col("__m") < 1.4) & (F.col("__one") > 0.7), F.lit(False))
    kind = F.when(one | (F.col("index") < 1.5), "isolating").when(F.col("index") >= 3.5, "polysynthetic").when(F.col("index") >= 2.3, "agglutinative").otherwise("fusional")
    return flagged.select(*keys, "index", "clean", kind.alias("type"))


def unexplained(vocabulary: DataFrame, peeled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stacked, exceptions): token shares of words that need two edges or more, and of words neither peeled to a known one nor reduplicated."""
    joined = vocabulary.join(peeled, [*keys, "word"])
    total = F.sum("n")
    stacked = F.sum(F.when(F.col("known") & (F.col("peeled") >= 2), F.col("n")).otherwise(0))
    lost = F.sum(F.when(~F.col("known") & reduplicated(F.col("word")).isNull(), F.col("n")).otherwise(0))
    return joined.groupBy(*keys).agg(F.try_divide(stacked, total).alias("stacked"), F.try_divide(lost, total).alias("exceptions"))


def additive_words(vocabulary: DataFrame, known: DataFrame, affixes: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, word, n): recurring unknown words that are a known word with one known edge, or one on each side.

    vocabulary: (keys, word, n), known: (keys, word), affixes: (keys, side, affix).
    """
    new = vocabulary.filter(F.col("n") >= least).join(known.select(*keys, "word").distinct(), [*keys, "word"], "left_anti")
    one = morph.edges(new.select(*keys, "word"), keys, "word", 6, 2).join(affixes.select(*keys, "side", "affix").distinct(), [*keys, "side", "affix"]).select(*keys, "word", "side", "stem")
    inner = morph.edges(one.filter("side = 'prefix'").select(*keys, F.col("stem").alias("middle")).distinct(), keys, "middle", 6, 2).filter("side = 'suffix'")
    inner = inner.withColumnRenamed("word", "middle").join(affixes.filter("side = 'suffix'").select(*keys, "affix").distinct(), [*keys, "affix"])
    both = one.filter("side = 'prefix'").select(*keys, "word", F.col("stem").alias("middle")).join(inner.select(*keys, "middle", "stem"), [*keys, "middle"])
    stems = one.select(*keys, "word", "stem").unionByName(both.select(*keys, "word", "stem"))
    good = stems.join(known.select(*keys, F.col("word").alias("stem")).distinct(), [*keys, "stem"], "left_semi").select(*keys, "word").distinct()
    return new.join(good, [*keys, "word"]).select(*keys, "word", "n")


def grow_roots(vocabulary: DataFrame, roots: DataFrame, affixes: DataFrame, keys: list[str], top: int = 20, stem: int = 3) -> DataFrame:
    """(keys, root, n): new roots: what the longest known edge of each word leaves, by token frequency, the first ``top`` of each key.

    roots: (keys, root); known roots and words without known edge give none.
    """
    cut = morph.edges(vocabulary.select(*keys, "word", "n"), keys, "word", 6, stem)
    hit = cut.join(affixes.select(*keys, "side", "affix").distinct(), [*keys, "side", "affix"])
    order = Window.partitionBy(*keys, "word").orderBy(F.length("affix").desc(), "side", "affix")
    best = hit.withColumn("__p", F.row_number().over(order)).filter("__p = 1")
    new = best.groupBy(*keys, F.col("stem").alias("root")).agg(F.sum("n").alias("n")).join(roots.select(*keys, "root").distinct(), [*keys, "root"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "root"))
    return new.withColumn("__p", place).filter(F.col("__p") <= top).select(*keys, "root", "n")


def label_affixes(glossed: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, side, affix, label, n): the English inflection that most pairs of a word and the word with the affix differ in.

    glossed: (keys, word, gloss).
    """
    cut = morph.edges(glossed.select(*keys, "word", "gloss"), keys, "word", 5, 2)
    base = glossed.select(*keys, F.col("word").alias("stem"), F.col("gloss").alias("base"))
    voted = cut.join(base, [*keys, "stem"]).withColumn("label", english_inflection(F.lower("base"), F.lower("gloss"))).filter("label is not null")
    counted = voted.groupBy(*keys, "side", "affix", "label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, "side", "affix").orderBy(F.desc("n"), "label")
    return counted.withColumn("__p", F.row_number().over(order)).filter((F.col("__p") == 1) & (F.col("n") >= least)).drop("__p")


def guided_splits(best: DataFrame, keys: list[str], root: int = 3, rest: int = 4, least: int = 2) -> DataFrame:
    """(keys, word, base, residue): source words to cut into a shorter source word and a residue, because the two align with different targets.

    best: (keys, source, target), the first target of each source word. The
    shortest base counts; a residue must recur on at least ``least`` words.
    """
    size = F.length("source")
    cut = best.filter(size > root).withColumn("__cut", F.explode(F.sequence(F.lit(root), size - 1)))
    split = cut.filter(size - F.col("__cut") <= rest).select(*keys, F.col("source").alias("word"), "target", F.expr("left(source, __cut)").alias("base"), F.expr("substr(source, __cut + 1)").alias("residue"))
    bases = best.select(*keys, F.col("source").alias("base"), F.col("target").alias("base_target"))
    differ = split.join(bases, [*keys, "base"]).filter(F.col("target") != F.col("base_target"))
    order = Window.partitionBy(*keys, "word").orderBy(F.length("base"))
    first = differ.withColumn("__p", F.row_number().over(order)).filter("__p = 1")
    recur = first.withColumn("__r", F.count(F.lit(1)).over(Window.partitionBy(*keys, "residue")))
    return recur.filter(F.col("__r") >= least).select(*keys, "word", "base", "residue")


def apply_splits(tokens: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, at, part, word): a token sequence with split words replaced by base and residue."""
    joined = tokens.join(splits, [*keys, "word"], "left")
    parts = F.when(F.col("base").isNotNull(), F.array("base", "residue")).otherwise(F.array("word"))
    return joined.select(*keys, "row", "at", F.posexplode(parts).alias("part", "word"))


def enumeration_debt(families: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, families, debt): forms beyond one that each family lists."""
    return families.groupBy(*keys).agg(F.count(F.lit(1)).alias("families"), F.sum(F.col("forms") - 1).alias("debt"))


def archiphonemes(families: DataFrame, keys: list[str], vowels: str = "aeiou") -> DataFrame:
    """(keys, pattern, alternants): families whose members differ in one vowel at one place, as a pattern with V there. families: (keys, members joined by blanks)."""
    members = F.split("members", " ")
    first = F.element_at(members, 1)
    rows = families.filter(F.size(F.array_distinct(F.transform(members, lambda m: F.length(m)))) == 1).withColumn("__m", members).withColumn("__f", first)
    differ = F.filter(F.sequence(F.lit(1), F.length("__f")), lambda i: F.exists("__m", lambda m: F.substr(m, i, F.lit(1)) != F.substr("__f", i, F.lit(1))))
    single = rows.withColumn("__d", differ).filter(F.size("__d") == 1).withColumn("__i", F.element_at("__d", 1))
    letters = F.array_sort(F.array_distinct(F.transform("__m", lambda m: F.substr(m, F.col("__i"), F.lit(1)))))
    made = single.withColumn("__l", letters).filter(F.forall("__l", lambda x: F.instr(F.lit(vowels), x) > 0))
    pattern = F.concat(F.expr("left(__f, __i - 1)"), F.lit("V"), F.expr("substr(__f, __i + 1)"))
    return made.select(*keys, pattern.alias("pattern"), F.array_join("__l", "").alias("alternants"))


def place_of(segment: Column) -> Column:
    """The place of articulation of a segment, or null."""
    out = F.lit(None).cast("string")
    for name, letters in PLACES.items():
        out = F.when(segment.isin(list(letters)), name).otherwise(out)
    return out


def place_histogram(vocabulary: DataFrame, prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefix, place, n): the places of the segments that follow each prefix, by tokens."""
    cut = morph.edges(vocabulary.select(*keys, "word", "n"), keys, "word", 4, 2).filter("side = 'prefix'")
    joined = cut.join(prefixes.select(*keys, F.col("prefix").alias("affix")).distinct(), [*keys, "affix"]).withColumn("place", place_of(F.expr("left(stem, 1)")))
    return joined.filter("place is not null").groupBy(*keys, F.col("affix").alias("prefix"), "place").agg(F.sum("n").alias("n"))


def residue_patterns(words: DataFrame, explained: DataFrame, keys: list[str], least: int = 4, top: int = 6) -> DataFrame:
    """(keys, side, edge, words): two-character edges that unexplained words of more than three characters cluster in, the largest first."""
    rest = words.select(*keys, "word").distinct().join(explained.select(*keys, "word").distinct(), [*keys, "word"], "left_anti").filter(F.length("word") > 3)
    sides = F.array(F.struct(F.lit("prefix").alias("side"), F.expr("left(word, 2)").alias("edge")), F.struct(F.lit("suffix").alias("side"), F.expr("right(word, 2)").alias("edge")))
    counted = rest.withColumn("e", F.explode(sides)).groupBy(*keys, "e.side", "e.edge").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") >= least)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("words"), "side", "edge"))
    return counted.withColumn("__p", place).filter(F.col("__p") <= top).drop("__p")


def shared_core(groups: DataFrame, keys: list[str], shortest: int = 3) -> DataFrame:
    """(keys, core, words): the substring that most words of a group share, by words x length, then length, then itself. groups: (keys, word)."""
    size = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size - shortest + 1), lambda i: F.transform(F.sequence(F.lit(shortest), size - i + 1), lambda n: F.substr("word", i, n))))
    parts = groups.select(*keys, "word").distinct().filter(size >= shortest).withColumn("core", F.explode(F.array_distinct(spans)))
    counted = parts.groupBy(*keys, "core").agg(F.count(F.lit(1)).alias("words")).filter("words >= 2")
    order = Window.partitionBy(*keys).orderBy((F.col("words") * F.length("core")).desc(), F.length("core").desc(), "core")
    return counted.withColumn("__p", F.row_number().over(order)).filter("__p = 1").drop("__p")


def examples(tokens: DataFrame, keys: list[str], row: str, word: str, most: int = 3) -> DataFrame:
    """(keys, word, n, examples): each word's frequency and the first rows it stands in, joined by bars."""
    first = tokens.groupBy(*keys, word, row).agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy(*keys, word).orderBy(row))
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__p") <= most, F.col(row)))), " | ")
    return first.withColumn("__p", place).groupBy(*keys, F.col(word).alias("word")).agg(F.sum("c").alias("n"), listed.alias("examples"))


def related_rows(tokens: DataFrame, focus: DataFrame, keys: list[str], row: str, top: int = 5, prefix: int = 4) -> DataFrame:
    """(keys, focus, row, weight, place): the rows that say most of the words beginning like the focus, by their frequencies together."""
    head = tokens.filter(F.length("word") >= prefix).withColumn("__h", F.substring("word", 1, prefix))
    n = head.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    asked = focus.select(*keys, "focus").distinct().filter(F.length("focus") >= prefix).withColumn("__h", F.substring("focus", 1, prefix))
    seen = head.select(*keys, row, "word", "__h").distinct().join(n, [*keys, "word"]).join(asked, [*keys, "__h"])
    scored = seen.groupBy(*keys, "focus", row).agg(F.sum("n").alias("weight"))
    place = F.row_number().over(Window.partitionBy(*keys, "focus").orderBy(F.desc("weight"), row))
    return scored.withColumn("place", place.cast("bigint")).filter(F.col("place") <= top)


def split_by_environment(source: DataFrame, target: DataFrame, inside: Column, morph_form: str) -> DataFrame:
    """(side, source, n, prob): what a morph aligns with inside an environment and outside it.

    target: (space, row, at, word, columns of ``inside``). The morph's tokens are
    renamed by the environment and the rows aligned anew.
    """
    side = F.when(inside, F.lit("in")).otherwise(F.lit("out"))
    renamed = target.withColumn("word", F.when(F.col("word") == morph_form, F.concat(F.col("word"), F.lit("\u0001"), side)).otherwise(F.col("word"))).select("space", "row", "at", "word")
    scores = align.dice_scores(source, renamed, "space", "row", "word")
    table = align.gloss_table(align.dice_links(source, renamed, scores)).filter(F.startswith("target", F.lit(morph_form + "\u0001")))
    return table.select(F.split_part("target", F.lit("\u0001"), F.lit(2)).alias("side"), "source", "n", "prob")


def until_dry(step: Callable[[int], int], rounds: int = 12, dry: int = 2) -> list[int]:
    """Call ``step(round)`` until it yields nothing new ``dry`` times in a row, or ``rounds`` times; what each round yielded."""
    got: list[int] = []
    for turn in range(rounds):
        got.append(step(turn))
        if len(got) >= dry and not any(got[-dry:]):
            break
    return got


def cotrain(vocabulary: DataFrame, roots: DataFrame, affixes: DataFrame, table: DataFrame | Callable[[DataFrame], DataFrame], keys: list[str], cycles: int = 6, least_prob: float = 0.3, least_count: int = 2, most_readings: float = 8.0) -> tuple[DataFrame, list[float]]:
    """(roots, coverage by cycle): roots added as long as they raise coverage.

    Each cycle parses the vocabulary, aligns anew over its readings, and proposes
    what the longest known prefix and suffix leave of each word without reading
    (the word itself if it has neither), if the gloss table is sure enough of the
    word. Roots with which a word parses are kept, in each key that they raise the
    coverage of with at most ``most_readings`` readings a parsed word; other keys
    are finished. Stops when no key goes on or no word is left to propose. keys is one column; roots: (key, form,
    gloss), affixes: (key, form, gloss, kind). table: (key, target, source, prob,
    n), or what makes it of the readings (space, word, analysis, line, forms).
    """
    key = keys[0]
    spaced = lambda df: df.withColumnRenamed(key, "space")
    fixes = spaced(affixes).select("space", "form", "gloss", "kind")
    longest = fixes.agg(F.max(F.length("form"))).collect()[0][0] or 1
    model = materialise(spaced(roots).select("space", "form", "gloss"), "roots")
    words = materialise(spaced(vocabulary), "words")

    def judged(parses: DataFrame) -> DataFrame:
        return materialise(assess.coverage(words, parses, ["space"]).join(assess.ambiguity(parses, ["space"]), ["space"], "left").select("space", "types", "parsed", "mean"), "judged")

    def share(state: DataFrame) -> float:
        return float(state.agg(F.sum("parsed") / F.sum("types")).collect()[0][0] or 0.0)

    def bare(lost: DataFrame, side: str) -> DataFrame:
        edge = fixes.filter(F.col("kind") == side).select("space", F.col("form").alias("affix"))
        cut = morph.longest_edge(lost, ["space"], "form", edge, side, 2, longest).select("space", F.col("word").alias("form"), F.col("stem").alias("__rest"))
        return lost.join(cut, ["space", "form"], "left").withColumn("form", F.coalesce("__rest", "form")).drop("__rest")

    parses = materialise(morph.parse_words(words, "space", "word", model, fixes), "parses")
    state = judged(parses)
    seen, active = [share(state)], state.select("space")
    for _ in range(cycles):
        unread = materialise(words.select("space", "word").join(active, "space", "left_semi").join(parses.select("space", "word").distinct(), ["space", "word"], "left_anti"), "unread")
        if unread.limit(1).count() == 0:
            break
        glosses = spaced(table(parses) if callable(table) else table)
        sure = glosses.filter((F.col("prob") >= least_prob) & (F.col("n") >= least_count)).select("space", F.col("target").alias("word"), F.col("source").alias("gloss"), "prob")
        lost = unread.join(sure, ["space", "word"])
        left = bare(bare(lost.withColumn("form", F.col("word")), "prefix"), "suffix").filter(F.length("form") >= 2)
        best = left.groupBy("space", "form").agg(F.min(F.struct(-F.col("prob"), "gloss"))["gloss"].alias("gloss"))
        proposed = materialise(best.join(model.select("space", "form"), ["space", "form"], "left_anti"), "proposed")
        if proposed.limit(1).count() == 0:
            break
        again = materialise(morph.parse_words(words, "space", "word", model.unionByName(proposed), fixes), "parses")
        now = judged(again)
        rose = now.join(state.select("space", F.col("parsed").alias("before")), "space").filter((F.col("parsed") > F.col("before")) & (F.col("mean") <= most_readings))
        active = materialise(rose.join(active, "space", "left_semi").select("space"), "active")
        if active.limit(1).count() == 0:
            break
        used = again.select("space", F.explode(F.split("forms", "-")).alias("form")).distinct()
        model = materialise(model.unionByName(proposed.join(active, "space", "left_semi").join(used, ["space", "form"], "left_semi")), "roots")
        kept = lambda new, old: new.join(active, "space", "left_semi").unionByName(old.join(active, "space", "left_anti"))
        parses, state = materialise(kept(again, parses), "parses"), materialise(kept(now, state), "judged")
        seen.append(share(state))
    return model.withColumnRenamed("space", key), seen
