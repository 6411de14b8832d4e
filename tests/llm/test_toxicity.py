"""Kneser-Ney evidence against the definition, thresholds, and odd rows of op1 and op6."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import quality, toxicity


def sample(seed, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = [f"w{int(x) % 60}" for x in rng.zipf(1.4, int(rng.integers(15, 60)))]
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), "slur")
            at = int(rng.integers(len(words)))
            words[at:at] = ["get", "lost"]
        else:
            words[5:5] = ["lost"]
            words[9:9] = ["kind"]
            words[2:2] = ["get"]
        rows.append((" ".join(words), toxic))
    return rows + rows[:30]


class Definition:
    """Both models from sets of contexts, word by word."""

    def __init__(self, rows):
        """rows: text, label, part."""
        triples = {(y, p, u, v, w) for t, y, p in rows for x in [toxicity.words(t.lower())] for u, v, w in zip(["", "", *x], ["", *x], x)}
        self.two = defaultdict(lambda: [0, 0])
        for y, _, _, v, w in triples:
            self.two[v, w][1 - y] += 1
        self.one = defaultdict(lambda: [0, 0])
        for y, _, _, w in {(y, p, v, w) for y, p, _, v, w in triples}:
            self.one[w][1 - y] += 1
        self.total = [sum(n[c] for n in self.one.values()) for c in (0, 1)]
        self.after = defaultdict(dict)
        for (v, w), n in self.two.items():
            self.after[v][w] = n
        self.own = {w for w, n in self.one.items() if sum(n) >= toxicity.CUTOFF and self.tells(n, self.total)}
        self.pairs = {(v, w) for (v, w), n in self.two.items() if sum(n) >= toxicity.CUTOFF <= sum(self.one[w]) and self.tells(n, [self.sum(v, c) * self.word(c, w) for c in (0, 1)])}

    def tells(self, n, expected):
        g = 2 * sum(k * math.log(k / (sum(n) * e / sum(expected))) for k, e in zip(n, expected) if k)
        return g / (1 + sum(n) / toxicity.SPREAD) >= toxicity.EVIDENCE

    def sum(self, v, c):
        return sum(n[c] for n in self.after[v].values())

    def kneser_ney(self, counts, c, w):
        total = sum(n[c] for n in counts.values())
        pooled = sum(counts[w]) / sum(map(sum, counts.values()))
        if not total:
            return pooled
        left = sum(min(n[c], toxicity.DISCOUNT) for n in counts.values())
        return (max(counts[w][c] - toxicity.DISCOUNT, 0) + left * pooled) / total

    def word(self, c, w):
        if w in self.own:
            return self.kneser_ney(self.one, c, w)
        shared = lambda w: sum(self.one[w]) / sum(self.total)
        rest = (1 - sum(self.kneser_ney(self.one, c, x) for x in self.own)) / (1 - sum(map(shared, self.own)))
        return rest * shared(w)

    def pair(self, c, v, w):
        own = [x for x in self.after.get(v, ()) if (v, x) in self.pairs]
        if w in own:
            return self.kneser_ney(self.after[v], c, w)
        left = (1 - sum(self.kneser_ney(self.after[v], c, x) for x in own)) / (1 - sum(self.word(c, x) for x in own))
        return left * self.word(c, w)

    def evidence(self, text):
        x = toxicity.words(text.lower())
        t, o = (sum(math.log(self.pair(c, v, w)) for v, w in zip(["", *x], x)) / max(1, len(x)) for c in (0, 1))
        return t - o


def test_evidence_is_the_difference_of_both_log_likelihoods(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    # twice as many ordinary rows: two parts
    part = F.when(F.col("label") == 1, 0).otherwise(F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(2)))
    own = Definition([tuple(r) for r in df.select("text", "label", part).collect()])
    model = toxicity.build(toxicity.count(df, 90, 180))
    assert {toxicity.word_hash(w) for w in own.own} == set(model.word.tolist()) and len(own.pairs) == len(model.key) > 0
    for c in (0, 1):  # both models are distributions
        assert math.isclose(sum(own.word(c, w) for w in own.one), 1)
        assert math.isclose(sum(own.pair(c, "get", w) for w in own.one), 1)
    for text, _ in rows[::9] + [("get lost slur kind W1", 0), ("slur", 1)]:
        assert math.isclose(model.evidence(toxicity.hashed([text])[0]), own.evidence(text), abs_tol=1e-9)
    # unseen words count for the length, and as words of the shared distribution
    assert math.isclose(model.evidence(toxicity.hashed(["never seen"])[0]), model.single[0])
    assert model.evidence(toxicity.hashed([" !? "])[0]) == 0.0


def test_the_threshold_does_not_depend_on_the_share_of_toxic_rows():
    rng = np.random.default_rng(5)
    few = np.concatenate((rng.normal(-1, 0.3, 4000), rng.normal(1, 0.3, 40)))
    many = np.concatenate((rng.normal(-1, 0.3, 4000), rng.normal(1, 0.3, 4000)))
    for x, n in ((few, 40), (many, 4000)):
        w = toxicity.curve(x, (np.arange(len(x)) >= 4000).astype(float))
        middle = -w[0] / w[1]
        assert (x[4000:] >= middle).mean() > 0.97 and (x[:4000] >= middle).mean() < 0.01
    x = np.zeros(10)  # evidence that tells nothing
    assert np.isfinite(toxicity.curve(x, np.arange(10) % 2 * 1.0)).all()


@pytest.mark.parametrize("share", [0.3, 0.05])
def test_recall_of_the_filter_with_common_and_rare_toxic_labels(spark, share):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4000):
        toxic = int(rng.random() < share)
        words = [f"w{int(x) % 400}" for x in rng.zipf(1.5, int(rng.integers(20, 80)))]
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(len(words))), f"slur{int(rng.integers(3))}")
        rows.append((i, " ".join(words), toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.keep(docs, toxicity.train(docs, labels, F.col("doc_id") % 2 == 0)).collect()}
    unseen = [(i, y) for i, _, y in rows if i % 2]
    assert np.mean([i not in kept for i, y in unseen if y]) > 0.9
    assert np.mean([i in kept for i, y in unseen if not y]) > 0.98


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_are_scored_row_by_row(spark, module, label):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x) % 50}" for x in rng.zipf(1.5, 30)) + (" vile vile!" if i % 2 else "")) for i in range(200)]
    long = "word " * 400_000 + "vile"
    odd = [(7, rows[7][1]), (7, "another text of this id"), (None, None), (None, ""), (5000, long)]
    # columns that operators might use themselves
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x", True) for i, t in rows + odd], "doc_id long, text string, label int, score double, v string, curve boolean")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (9, None), (5000, 1)], f"doc_id long, {label} int")
    got = module.score_documents(docs, marks).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    same = [r.score for r in got if r.doc_id == 7]
    assert len(same) == 3 and len(set(same)) == 2
    kept = module.keep(docs, module.train(docs, marks, F.lit(True)))
    assert kept.columns == docs.columns and 0 < kept.count() <= 205
