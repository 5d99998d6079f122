"""Scoring documents for abusive, hateful or sexual content (problem 8).

Multiple-instance learning: a document is a bag of sentences of which only the
bag is labelled. Each sentence gets a score by a logistic model over hashed
features, a document's score is the noisy-or of its sentences, and the model is
trained through that noisy-or from the documents' labels, so that it learns by
itself which sentences offend. The same sentence scores locate them afterwards.

Labels are votes of annotators who err. How often they do is estimated together
with each document's label (expectation maximisation over the votes), and the
labels are estimated again with the model's own held-out opinion as prior.

Training sees at most ``SAMPLE`` labelled documents, those with the smallest
hash of their id; everything else is done for every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.llm import grams
from morphloom.operators.live import live_rows

#: Labelled documents the model is fitted on, at most.
SAMPLE = 10_000
#: Features are hashed to so many bits.
BITS = 20
#: A document with at least this score counts as a case.
THRESHOLD = 0.4
#: Gradient passes, documents a step, learning rate, shrinkage, and documents a feature must stand in.
EPOCHS, BATCH, RATE, SHRINK, LEAST_BAGS = 12, 128, 0.35, 0.005, 3
#: Passes after which features whose weight is 0 leave the fit.
SCREEN = 2
#: How often labels are estimated again with held-out scores.
ROUNDS = 4


class Lexicon(NamedTuple):
    """Seed terms and names of peoples by the hashes of their forms: sorted hashes of seeds, category and form of each, hashes of peoples."""

    seeds: np.ndarray
    labels: list[tuple[str, str]]
    peoples: np.ndarray


def form_of(text: str) -> str:
    """The one form of a term that is a single word; else its folded text."""
    found = grams.fold(text)
    joined = "".join(map(chr, found.tolist()))
    return grams.word(joined) if joined else ""


def lexicon(terms: list[tuple[str, str, int]], names: list[str]) -> Lexicon:
    """From (term, category, strength) rows and names of speaker communities."""
    seeds = {form_of(term): f"{category}:{strength}" for term, category, strength in terms if term}
    peoples = {form_of(n) for n in names if n}
    peoples |= {p + end for p in peoples if p[-1:] != "s" for end in ("s", "ss")}
    forms = sorted(seeds)
    made = grams.hashes_of(forms)[:, 0]
    order = np.argsort(made)
    return Lexicon(made[order], [(seeds[forms[i]], forms[i]) for i in order], np.sort(grams.hashes_of(sorted(peoples))[:, 0]))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The place of each value in ``ordered``, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[place] == values, place, -1)


class Sentences(NamedTuple):
    """The sentences with words of a group of texts: hashed features with the sentence of each, and the words they are of."""

    parts: list[tuple[np.ndarray, np.ndarray]]
    words: grams.Words


ONE, TWO, THREE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)


def _seed_features(words: grams.Words, seed: np.ndarray, known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Two features for each seed term: its category and itself, each with whether it stands in a quotation."""
    hits = np.flatnonzero(seed >= 0)
    signs, out = [chr(c) for c in words.codes[words.marks].tolist()], []
    low, high = np.searchsorted(words.marks_at, words.at[hits]), np.searchsorted(words.marks, words.starts[hits])
    for p, i, j in zip(seed[hits].tolist(), low.tolist(), high.tolist(), strict=True):
        quoted = False
        for mark in signs[i:j]:
            quoted = not quoted if mark == '"' else mark in "„“«‹" and not quoted
        category, form = known.labels[p]
        out += [zlib.crc32(f"s:{category}:{quoted}".encode()), zlib.crc32(f"s:{form}:{quoted}".encode())]
    return np.array(out, np.uint64), np.repeat(words.at[hits], 2)


def features(texts: list[str | None], known: Lexicon) -> Sentences:
    """The sentences of whole texts and their hashed features, for a group of texts at once.

    A feature is a word, its consonants, its letters in any order, a pair or triple
    of neighbouring words, a pair with one word between, a pair of consonant
    skeletons, a quotation mark, or a seed term. Names of peoples are one word.
    """
    words = grams.words_of(texts)
    h, s = words.hashes, words.at
    seed = _among(h[:, 0], known.seeds)
    h[_among(h[:, 0], known.peoples) >= 0] = zlib.crc32(b"<people>")
    raw = [(h[:, 0], s), (h[:, 1], s), (h[:, 2], s), (np.full(len(words.marks), zlib.crc32(b"<quote>"), np.uint64), words.marks_at), _seed_features(words, seed, known)]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            same = s[gap:] == s[:-gap]
            raw.append(((h[:-gap, 0] * ONE + h[gap:, 0] * TWO + np.uint64(gap))[same], s[gap:][same]))
        same = s[2:] == s[:-2]
        raw.append(((h[:-2, 0] * ONE + h[1:-1, 0] * TWO + h[2:, 0] * THREE)[same], s[2:][same]))
        same = s[1:] == s[:-1]
        raw.append(((h[:-1, 1] * ONE + h[1:, 1] * TWO + np.uint64(7))[same], s[1:][same]))
        parts = [(((x * MIX) >> np.uint64(64 - BITS)).astype(np.int32), at) for x, at in raw]
    return Sentences(parts, words)


def sentence_scores(found: Sentences, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each sentence."""
    sums = np.zeros(len(found.words.owner))
    for ids, at in found.parts:
        sums += np.bincount(at, weights=weights[ids], minlength=len(sums))
    return 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30)))


def noisy_or(scores: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text the chance that at least one of its sentences offends; 0 for a text without sentences."""
    return -np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=texts))


def vote_posteriors(yes: np.ndarray, no: np.ndarray, prior: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """P(case) of each document from its votes, with the annotators' error rates estimated along."""
    miss, false, share = 0.1, 0.05, 0.1
    post = np.zeros(len(yes))
    for _ in range(rounds):
        base = np.full(len(yes), share) if prior is None else np.clip(prior, 0.01, 0.99)
        case = np.log(base) + yes * np.log(1 - miss) + no * np.log(miss)
        other = np.log(1 - base) + yes * np.log(false) + no * np.log(1 - false)
        post = 1 / (1 + np.exp(np.clip(other - case, -60, 60)))
        votes = yes + no
        miss = float(np.clip((post * no).sum() / max((post * votes).sum(), 1e-9), 0.01, 0.3))
        false = float(np.clip(((1 - post) * yes).sum() / max(((1 - post) * votes).sum(), 1e-9), 0.005, 0.2))
        share = float(np.clip(post.mean() if len(post) else 0.1, 0.005, 0.5))
    return post


class Bags(NamedTuple):
    """Training documents: features of all sentences in a row, how many each sentence has, how many sentences each document has."""

    ids: np.ndarray
    per_sentence: np.ndarray
    per_bag: np.ndarray

    def take(self, rows: np.ndarray) -> "Bags":
        first = np.concatenate([[0], np.cumsum(self.per_bag)])
        sent = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
        start = np.concatenate([[0], np.cumsum(self.per_sentence)])
        flat = np.concatenate([self.ids[start[x] : start[x + 1]] for x in sent]) if len(sent) else np.zeros(0, np.int32)
        return Bags(flat, self.per_sentence[sent], self.per_bag[rows])


def compact(bags: Bags, least: int = LEAST_BAGS) -> tuple[Bags, np.ndarray]:
    """The bags with features of at least ``least`` documents, renumbered, and those features' hashes."""
    owner = np.repeat(np.repeat(np.arange(len(bags.per_bag)), bags.per_bag), bags.per_sentence)
    both = np.sort((bags.ids.astype(np.int64) << 32) | owner)
    once = both[np.flatnonzero(np.diff(both, prepend=-1))] >> 32
    known = np.flatnonzero(np.bincount(once, minlength=1 << BITS) >= least)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[known] = np.arange(len(known))
    mapped = slot[bags.ids]
    keep = mapped >= 0
    of = np.repeat(np.arange(len(bags.per_sentence)), bags.per_sentence)
    return Bags(mapped[keep], np.bincount(of[keep], minlength=len(bags.per_sentence)), bags.per_bag), known


class Step(NamedTuple):
    """One step's documents: their distinct features, the place of each feature among those, its sentence, the document of each sentence, and their rows."""

    used: np.ndarray
    local: np.ndarray
    of: np.ndarray
    bag: np.ndarray
    rows: np.ndarray


def steps_of(bags: Bags, size: int = BATCH, seed: int = 7) -> list[Step]:
    """The documents that have sentences, in a drawn order, cut into steps of ``size``; of fewer where documents are few."""
    order = np.random.default_rng(seed).permutation(np.flatnonzero(bags.per_bag > 0))
    place = np.zeros(1 << BITS, np.int64)
    out = []
    size = max(4, min(size, len(order) // 16))
    for i in range(0, len(order), size):
        chosen = np.sort(order[i : i + size])
        part = bags.take(chosen)
        place[part.ids] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        local = place[part.ids]
        place[used] = 0
        out.append(Step(used, local, np.repeat(np.arange(len(part.per_sentence)), part.per_sentence), np.repeat(np.arange(len(chosen)), part.per_bag), chosen))
    return out


def _screened(step: Step, keep: np.ndarray) -> Step:
    """The step with the features of ``keep`` alone."""
    own = keep[step.used]
    place = np.cumsum(own) - 1
    stay = own[step.local]
    return Step(step.used[own], place[step.local[stay]], step.of[stay], step.bag, step.rows)


def _sentence_sums(step: Step, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.clip(bias + np.bincount(step.of, weights=weights[step.used][step.local], minlength=len(step.bag)), -30, 30)


def fit(steps: list[Step], target: np.ndarray, size: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and bias, by stochastic gradients of the noisy-or likelihood under soft targets.

    Step widths adapt to each weight; weights are drawn to 0 and stay there
    without evidence (proximal steps), so features that happen to stand beside an
    offence in a few documents get none. After ``SCREEN`` passes those at 0 leave.
    """
    weights, scale = np.zeros(size), np.full(size, 0.05)
    bias, bias_scale = -4.0, 1.0
    draw = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        if epoch == SCREEN:
            steps = [_screened(s, weights != 0) for s in steps]
        for k in draw.permutation(len(steps)):
            used, local, of, bag, rows = steps[k]
            z = _sentence_sums(steps[k], weights, bias)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(np.bincount(bag, weights=-np.logaddexp(0, z)))
            q = target[rows]
            push = np.clip(p * ((1 - q) - q * none / np.maximum(1 - none, 1e-9))[bag], -2, 2)
            step = np.bincount(local, weights=push[of], minlength=len(used))
            scale[used] += step**2
            width = RATE / np.sqrt(scale[used])
            moved = weights[used] - width * step
            weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - width * SHRINK, 0)
            total = push.sum()
            bias_scale += total**2
            bias -= RATE * total / np.sqrt(bias_scale)
    return weights, float(bias)


def train(bags: Bags, yes: np.ndarray, no: np.ndarray, rounds: int = ROUNDS, folds: int = 4) -> tuple[np.ndarray, float]:
    """The model: labels from votes, then ``rounds`` times from votes and scores by models that have not seen the document, then the fit to them."""
    small, known = compact(bags)
    size, steps = len(known), steps_of(small)
    target = vote_posteriors(yes, no)
    for turn in range(rounds if len(steps) >= 2 * folds else 0):
        opinion = np.zeros(len(target))
        for k in range(folds):
            weights, bias = fit([s for i, s in enumerate(steps) if i % folds != k], target, size, seed=turn)
            for step in steps[k::folds]:
                opinion[step.rows] = -np.expm1(np.bincount(step.bag, weights=-np.logaddexp(0, _sentence_sums(step, weights, bias))))
        target = vote_posteriors(yes, no, opinion)
    weights, bias = fit(steps, target, size)
    full = np.zeros(1 << BITS, np.float32)
    full[known] = weights
    return full, bias


class Model(NamedTuple):
    """What scoring needs: weights, bias, and the lexicon."""

    weights: np.ndarray
    bias: float
    known: Lexicon


def labelled_bags(documents: DataFrame, votes: DataFrame, known: Lexicon, sample: int = SAMPLE) -> tuple[Bags, np.ndarray, np.ndarray]:
    """Features and vote counts of at most ``sample`` labelled documents.

    An annotator's latest vote on a document counts; null votes do not.
    """
    last = live_rows(votes.select("doc_id", "annotator", "voted_at", "flagged"), ["doc_id", "annotator"], "voted_at").filter(F.col("flagged").isNotNull())
    counted = last.groupBy("doc_id").agg(F.sum(F.when(F.col("flagged") == 1, 1).otherwise(0)).alias("yes"), F.count(F.lit(1)).alias("votes"))
    chosen = counted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of three numbers are broadcast, so the texts are not exchanged
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "yes", "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = [], []
            for _, texts in grams.groups(batch.column(1).to_pylist()):
                found = features(texts, known)
                place = np.concatenate([at for _, at in found.parts])
                flat = np.concatenate([x for x, _ in found.parts])[np.argsort(place, kind="stable")]
                per_sentence = np.bincount(place, minlength=len(found.words.owner)).astype(np.int32)
                first = np.concatenate([[0], np.cumsum(per_sentence)])
                bounds = np.searchsorted(found.words.owner, np.arange(len(texts) + 1)).tolist()
                ids += [flat[first[i] : first[j]].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                lengths += [per_sentence[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(ids, pa.binary()), pa.array(lengths, pa.binary())], names=["doc_id", "yes", "votes", "ids", "lengths"])

    got = rows.mapInArrow(run, "doc_id bigint, yes bigint, votes bigint, ids binary, lengths binary").toArrow().sort_by("doc_id")
    lengths = [np.frombuffer(x.as_py(), np.int32) for x in got["lengths"]]
    ids = [np.frombuffer(x.as_py(), np.int32) for x in got["ids"]]
    none = np.zeros(0, np.int32)
    bags = Bags(np.concatenate([none, *ids]), np.concatenate([none, *lengths]), np.array([len(x) for x in lengths], np.int64))
    yes = got["yes"].to_numpy().astype(float)
    return bags, yes, got["votes"].to_numpy().astype(float) - yes


def learn(documents: DataFrame, votes: DataFrame, terms: DataFrame, languages: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the labelled documents. terms and languages are fixed tables of a few dozen rows."""
    known = lexicon([tuple(r) for r in terms.select("term", "category", "strength").collect()], [r[0] for r in languages.select("language").collect()])
    bags, yes, no = labelled_bags(documents, votes, known, sample)
    weights, bias = train(bags, yes, no) if len(yes) else (np.zeros(1 << BITS, np.float32), -4.0)
    return Model(weights, bias, known)


def score_documents(documents: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of ``keep``, score): the noisy-or over all sentences of the whole text; 0 for a null, empty or wordless one.

    One row for each row of ``documents``, repeated ones included.
    """
    weights, bias, known = model
    rows = documents.select(F.col("text").alias("__text"), key, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, texts in grams.groups(batch.column(0).to_pylist()):
                found = features(texts, known)
                scores.append(noisy_or(sentence_scores(found, weights, bias), found.words.owner, len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(scores))], names=[key, *keep, "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, f"{kinds}, score double")


def locate_sentences(documents: DataFrame, model: Model, least: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(key, sentence_no, score, sentence): the sentences with at least the given score, in folded spelling, numbered from 1 over those with words."""
    weights, bias, known = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, scores, parts = [], [], [], []
            for start, texts in grams.groups(batch.column(1).to_pylist()):
                found = features(texts, known)
                scored, owner = sentence_scores(found, weights, bias), found.words.owner
                for k in np.flatnonzero(scored >= least).tolist():
                    at.append(start + int(owner[k]))
                    numbers.append(k - int(np.searchsorted(owner, owner[k])) + 1)
                    scores.append(float(scored[k]))
                    parts.append(found.words.text(k))
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(numbers, pa.int32()), pa.array(scores, pa.float64()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "sentence_no", "score", "sentence"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"`{key}` {kind}, sentence_no int, score double, sentence string")
