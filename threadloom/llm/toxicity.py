"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text, count an expression (a word, or a
word after another) by the distinct words seen before it, as Kneser-Ney continuation counts do,
at both orders; a text that is copied a thousand times therefore counts little more than once. As distinct words
before an expression grow less than in proportion to the text that is read, the larger class is dealt into parts of about
the smaller one's rows, and counts are sums over parts.
Each class discounts its counts by ``DISCOUNT`` and gives what that leaves to the counts of both classes
together. An expression whose counts don't tell the classes apart (it is rarer than ``CUTOFF``, or a
likelihood-ratio test of its split between them stays below ``EVIDENCE``) has no probability of its own: all
of these share the backoff distribution of the pooled counts, so that a rare expression's factor is the same under both models but for
the mass that the others leave for them, which makes both models sum to one.

A document's log-likelihoods under the two models, each divided by its length, are compared: their difference,
of either sign, is ``Model.evidence``. Factors of the shared distribution are equal in both and cancel. A logistic curve over it, fitted
on training rows that the counts haven't seen, turns it into a probability; both classes weigh the same there.
Its middle, the score of 0.5, is where on those rows the share of toxic rows caught less ``LOSS`` times the share of ordinary rows
lost is largest. So neither depends on how common toxic labels are.

The classifier is fitted on a bounded sample: at most ``per_class`` labelled rows of
each class, those of the smallest hash, and at most ``class_chars`` characters of each. They are counted on the cluster; the driver gets
only expressions that occur ``CUTOFF`` times or more. Every document is scored, whole.

Defined results: a null or empty text, or one without words, has evidence 0 and is scored by the curve like any other;
null ids and repeated rows are scored row by row; rows with null labels or null ids in
``labels`` are ignored; a document labelled twice counts as toxic if any label says so;
without toxic or without ordinary training rows every score is the share of toxic rows
among all labelled ones (0 without any). Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, materialize, slices, text_column

#: Bounds of the training sample: rows of each class, and characters of each class.
PER_CLASS = 4000
CLASS_CHARS = 24_000_000
CUTOFF, EVIDENCE, DISCOUNT = 4, 10.0, 0.75
#: Counts of common expressions vary with topics more than by chance: the variance that the test takes is larger by n / SPREAD.
SPREAD = 100
#: For the threshold, a share of ordinary rows that is lost weighs so many times a share of toxic rows that is missed.
LOSS = 4
#: One training row in so many is for the curve.
CURVE = 4
#: Word hashes that a Python worker keeps at once.
CACHE = 500_000
words = re.compile(r"\w+").findall


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)


#: What stands before a text's first word; no word is empty.
START = word_hash("")


@dataclass
class Counts:
    """Of the classes (toxic, ordinary): rows of what occurs CUTOFF times or more, and totals of all."""

    word: np.ndarray  # sorted hashes
    n: np.ndarray  # word, class
    total: np.ndarray  # class
    left: np.ndarray  # class: discounts of all words
    before: np.ndarray  # of each pair, the hash of the first word,
    after: np.ndarray  # and of the second
    pairs: np.ndarray  # pair, class
    pair_total: np.ndarray  # pair, class: of all pairs with this first word
    pair_left: np.ndarray  # pair, class: and their discounts


@dataclass
class Model:
    """Logarithms of toxic over ordinary probabilities; factors that both share are left out."""

    word: np.ndarray  # sorted hashes of words with probabilities of their own
    single: np.ndarray  # by place in word, from 1; 0: all other words
    context: dict[int, int]  # hash of a first word to its number, from 1
    left: np.ndarray  # by this number: of words that don't make a pair with it, besides single; 0: other first words
    second: dict[int, int]  # hash of a second word to its number, from 1
    key: np.ndarray  # sorted: number of the first word * (len(second) + 1) + number of the second
    pair: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # of the logistic curve

    def evidence(self, hashes: np.ndarray) -> float:
        """Difference of the length-normalised log-likelihoods of a text's words."""
        if not len(hashes):
            return 0.0
        ids = np.zeros(len(hashes), np.int64)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
            ids = np.where(self.word[at] == hashes, at + 1, 0)
        total = self.single[ids]
        if len(self.key):
            before = np.fromiter(map(self.context.get, [START, *hashes[:-1].tolist()], repeat(0)), np.int64, len(hashes))
            near = np.flatnonzero(before)
            before = before[near]
            key = before * (len(self.second) + 1) + np.fromiter(map(self.second.get, hashes[near].tolist(), repeat(0)), np.int64, len(near))
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            total[near] = np.where(self.key[at] == key, self.pair[at], total[near] + self.left[before])
        return float(total.sum() / len(hashes))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(np.stack((np.ones(len(evidence)), evidence), 1) @ self.weights)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _test(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic, less by the spread, of counts of the two classes against a split in proportion to expected."""
    split = n.sum(1, keepdims=True) * expected / np.maximum(expected.sum(1, keepdims=True), 1e-300)
    return 2 * (n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, np.maximum(split, 1e-300), 1))).sum(1) / (1 + n.sum(1) / SPREAD)


def build(c: Counts, evidence: float = EVIDENCE) -> Model:
    shared = c.n.sum(1) / c.total.sum()
    own = (np.maximum(c.n - DISCOUNT, 0) + c.left * shared[:, None]) / c.total
    tells = _test(c.n, c.total[None]) >= evidence
    # what the words with their own probabilities leave goes to the shared distribution of the others
    rest = (1 - own[tells].sum(0)) / (1 - shared[tells].sum())
    alone = np.where(tells[:, None], own, rest * shared[:, None])
    word, single = c.word[tells], np.concatenate((rest[None], own[tells]))
    # pairs against what words alone make of them; a pair's second word is among those counted
    alone = alone[np.searchsorted(c.word, c.after)]
    tells = _test(c.pairs, c.pair_total * alone) >= evidence
    first, after, alone, n, total = (x[tells] for x in (c.before, c.after, alone, c.pairs, c.pair_total))
    pooled = n.sum(1, keepdims=True) / total.sum(1, keepdims=True)
    q = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + c.pair_left[tells] * pooled) / np.maximum(total, 1), pooled)
    contexts, number = np.unique(first, return_inverse=True)
    mass = lambda x: 1 - np.stack([np.bincount(number, x[:, k], len(contexts)) for k in (0, 1)], 1)
    left = np.concatenate((np.ones((1, 2)), np.maximum(mass(q), 1e-9) / np.maximum(mass(alone), 1e-9)))
    seconds, place = np.unique(after, return_inverse=True)
    key = (number + 1) * (len(seconds) + 1) + place + 1
    order = np.argsort(key)
    ratio = lambda x: np.log(x[:, 0] / x[:, 1])
    numbers = lambda x: {h: i for i, h in enumerate(x.tolist(), 1)}
    return Model(word, ratio(single), numbers(contexts), ratio(left), numbers(seconds), key[order], ratio(q)[order])


def hashed(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words; a word's is kept for the next."""
    if len(_known) > CACHE:
        _known.clear()
    found = [words(t.lower()) for t in texts]
    return [np.fromiter(map(_known.__getitem__, x), np.int64, len(x)) for x in found]


class _Known(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = word_hash(word)
        return value


_known = _Known()


def count(rows: DataFrame, toxic: int = 1, ordinary: int = 1) -> Counts:
    """rows: text, label; how many of each label there are. Everything but the rows that Counts holds stays on the cluster."""
    parts = (max(1, round(ordinary / toxic)), max(1, round(toxic / ordinary)))  # by label

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = hashed(part.column(0).to_pylist())
                sizes = [len(x) for x in found]
                w = np.concatenate([*found, np.zeros(0, np.int64)])
                v = np.concatenate([np.concatenate(([START], x[:-1])) for x in found if len(x)] or [w])
                u = np.concatenate([np.concatenate(([START, START], x[:-2]))[: len(x)] for x in found if len(x)] or [w])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, w, np.repeat(part.column(1).to_numpy(), sizes))], ["u", "v", "w", "class"])

    kinds = ("t", "o")
    # equal texts go to one part
    dealt = rows.select("text", (F.pmod(F.xxhash64(F.lit("part"), "text"), F.when(F.col("label") == 1, parts[1]).otherwise(parts[0])) * 2 + F.col("label")).alias("class"))
    triples = dealt.mapInArrow(run, "u long, v long, w long, class long").distinct()
    found = materialize(triples.groupBy("class", "v", "w").count(), "pairs")
    of = lambda n: [F.coalesce(F.sum(F.when(F.col("class").bitwiseAND(1) == y, n)), F.lit(0)).alias(k) for k, y in zip(kinds, (1, 0))]
    pairs, singles = found.groupBy("v", "w").agg(*of(F.col("count"))), found.groupBy("w").agg(*of(F.lit(1)))
    discounts = [F.sum(F.least(F.col(k), F.lit(DISCOUNT))).alias(f"{k}_left") for k in kinds]
    sums = singles.agg(*(F.sum(k).alias(k) for k in kinds), *discounts).first()
    known = _columns(singles.where(F.col("t") + F.col("o") >= CUTOFF), "w")
    common = pairs.where(F.col("t") + F.col("o") >= CUTOFF)
    totals = pairs.groupBy("v").agg(*(F.sum(k).alias(f"{k}_total") for k in kinds), *discounts)
    both = common.join(totals, "v").select("v", "w", "t", "o", "t_total", "o_total", "t_left", "o_left")
    v, w, *values = _columns(both, "v", "w")
    # a pair with enough contexts may have a second word with too few first ones
    order = np.argsort(known[0])
    known = [x[order] for x in known]
    kept = np.isin(w, known[0])
    two = lambda i: np.stack(values[i : i + 2], 1)[kept].astype(float)
    return Counts(
        known[0], np.stack(known[1:], 1).astype(float), np.maximum([sums.t or 0, sums.o or 0], 1).astype(float), np.array([sums.t_left or 0, sums.o_left or 0], float),
        v[kept], w[kept], two(0), two(2), two(4),
    )


def _columns(df: DataFrame, *keys: str) -> list[np.ndarray]:
    found = df.toArrow()
    return [found.column(c).to_numpy() for c in (*keys, *(c for c in df.columns if c not in keys))]


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve for evidence x of rows of both classes y."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    slope = _logistic(x, y, weight)[1]
    # between any two neighbours, the classes' shares above
    order = np.argsort(x, kind="stable")
    ends, label = x[order], y[order]
    caught, lost = 1 - np.cumsum(label) / label.sum(), 1 - np.cumsum(1 - label) / (1 - label).sum()
    gap = np.diff(ends)
    gain = np.where(gap > 0, (caught - LOSS * lost)[:-1], -np.inf)
    if not len(gap) or gain.max() <= 0 or slope <= 0:
        return _logistic(x, y, weight)
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = best[gap[best].argmax()]
    return np.array([-slope * (ends[k] + ends[k + 1]) / 2, slope])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.stack((np.ones(len(x)), x), 1)
    b = np.zeros(x.shape[1])
    loss = lambda b: float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b)) + ridge * b @ b / 2)
    for _ in range(60):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (weight * (p - y)) + ridge * b)
        k = 1.0
        while k > 1e-6 and loss(b - k * step) > loss(b):
            k /= 2
        b = b - k * step
        if np.abs(k * step).max() < 1e-9:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> Model | float:
    """usable: condition on doc_id; labels of other rows are never read."""
    sample, (positive, n) = labelled_sample(docs, labels, "toxic", usable, per_class, class_chars)
    # equal texts fall on the same side
    of_curve = F.pmod(F.xxhash64("text"), F.lit(CURVE)) == 0
    have = sample.where(~of_curve).agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o")).first()
    if not have.t or not have.o:
        return positive / n if n else 0.0
    model = build(count(sample.where(~of_curve), have.t, have.o))
    seen = _mapped(sample.where(of_curve).select("label", "text"), model, "label int", lambda x: x).collect()  # two numbers for each of at most 2 * per_class rows
    y, x = np.array([r.label for r in seen], float), np.array([r.score for r in seen], float)
    if 0 < y.sum() < len(y):
        model.weights = curve(x, y)
    return model


def _scores(model: Model | float, texts: list[str]) -> np.ndarray:
    """Evidence of each text, or the constant."""
    return np.full(len(texts), model) if isinstance(model, float) else np.array([model.evidence(x) for x in hashed(texts)])


def _mapped(rows: DataFrame, model: Model | float, first: str, then) -> DataFrame:
    """The first of two columns (declared by first), and score, which then makes of the second's evidence."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    name = first.split()[0]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(then(_scores(held.value, part.column(1).to_pylist())), pa.float64())], [name, "score"])

    return rows.mapInArrow(run, f"{first}, score double")


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    own = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    then = (lambda x: x) if isinstance(model, float) else model.score
    return _mapped(own, model, "doc_id long", then).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows that aren't held out."""
    held_out = fold(5) == 0
    model = train(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of docs, all columns, whose text isn't toxic (score < 0.5)."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch):
                found = _scores(model, [t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array((found if isinstance(model, float) else model.score(found)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
