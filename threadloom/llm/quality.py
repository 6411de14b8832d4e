"""Quality by a generalised additive model with pairwise interactions.

Each document becomes ``len(FEATURES)`` numbers. Cyclic boosting visits one feature
after another, fits a tree of depth two to the current gradient over that feature's
bins, and adds it to the feature's lookup table; then the pairs whose residuals interact
most get two-dimensional tables in the same way. Scoring looks up bins and adds.

The model is fitted on a bounded sample, at most ``per_class`` labelled rows of each
class, those of the smallest hash; every document is scored, whole.

Defined results: a null or empty text is scored like any other, by features that are all
zero; null ids and repeated rows are scored row by row; null labels or ids in ``labels``
are ignored, and of several labels for an id the largest holds; with one class only (or no
labels) every score is the share of good rows among all labelled ones (0 without any). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, slices, text_column

FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "stops", "symbols", "exclaims", "bars", "distinct_words",
    "words_a_line", "distinct_lines", "longest_word", "short_words", "non_ascii", "commonest_word", "closed_lines", "symbol_ends",
)
#: Bounds of the training sample: rows of each class, and characters of each class.
PER_CLASS = 8000
CLASS_CHARS = 64_000_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 6, 120, 60, 0.15, 2.0
_upper, _digit = np.zeros(256), np.zeros(256)
_upper[65:91] = 1
_digit[48:58] = 1
_letter = np.zeros(256)
_letter[65:91] = _letter[97:123] = 1
_stop, _symbol = np.zeros(256), np.zeros(256)
_stop[[*b".,;:?'\"()-"]] = 1
_symbol[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_wide = np.zeros(256)
_wide[128:] = 1


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, letters = len(raw), max(1.0, float(bytes_ @ _letter))
    found = raw.split()
    w = max(1, len(found))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    seen: dict[bytes, int] = {}
    for x in found:
        seen[x] = seen.get(x, 0) + 1
    ends = np.bincount(np.frombuffer(b"".join([x[-1:] for x in found]), np.uint8), minlength=256) if found else bytes_ * 0
    return [
        float(np.log1p(len(found))), float(np.log1p(n)), float(sizes.sum() / w), float(bytes_ @ _upper) / letters, float(bytes_ @ _digit) / n,
        float(bytes_ @ _stop) / w, float(bytes_ @ _symbol) / w, float(bytes_[33]) / w, float(bytes_[124]) / w, len(seen) / w / (1 + 0.1 * np.log1p(len(found))),
        len(found) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), float(sizes.max(initial=0)), float((sizes <= 3).sum()) / w,
        float(bytes_ @ _wide) / n, max(seen.values(), default=0) / w, sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines) / max(1, len(lines)), float(ends @ _symbol) / w,
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), values in zip(self.pairs, self.pair_tables):
            z += values[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return z


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-12 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    k = _cut(g, h)[1] if depth else 0
    if not k:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, depth: int = 3) -> np.ndarray:
    """The same over two features: each cut takes the better of the two."""
    (a, i), (b, j) = _cut(g.sum(1), h.sum(1)), _cut(g.sum(0), h.sum(0))
    if not depth or not (i or j):
        return np.full(g.shape, _leaf(g.sum(), h.sum()))
    if i and a >= b:
        return np.concatenate([_tree2(g[:i], h[:i], depth - 1), _tree2(g[i:], h[i:], depth - 1)])
    return np.concatenate([_tree2(g[:, :j], h[:, :j], depth - 1), _tree2(g[:, j:], h[:, j:], depth - 1)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None) -> Model | float:
    """share: of positive rows among all labelled ones, where rows are a sample by class."""
    if len(x) == 0 or y.min() == y.max():
        return float(share if share is not None else y.mean() if len(y) else 0.0)
    share = y.mean() if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model = Model(float(np.log(share / (1 - share))), [_edges(c, BINS) for c in x.T], [], [], [_edges(c, PAIR_BINS) for c in x.T], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    z = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(model.tables[f])), np.bincount(b, h, len(model.tables[f])))
            model.tables[f] += step
            z += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a, b, v):
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        gg, hh = grid(a, b, g), grid(a, b, h)
        gains.append((float((gg**2 / (hh + RIDGE)).sum() - (gg.sum(1) ** 2 / (hh.sum(1) + RIDGE)).sum() - (gg.sum(0) ** 2 / (hh.sum(0) + RIDGE)).sum()), (a, b)))
    model.pairs = [p for _, p in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _tree2(grid(a, b, g), grid(a, b, h))
            model.pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return model


def _features_of(docs: DataFrame) -> DataFrame:
    """docs with text's features in place of text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values = [features(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(values, pa.list_(pa.float64()))], [*names, "x"])

    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> Model | float:
    """usable: condition on doc_id; labels of other rows are never read."""
    sample, (positive, n) = labelled_sample(docs, labels, "quality", usable, per_class, class_chars)
    rows = sorted((r.doc_id, r.label, r.x) for r in _features_of(sample).collect())
    return fit(np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float), positive / n if n else None)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                scores = np.full(len(texts), model) if isinstance(model, float) else 1 / (1 + np.exp(-model.logits(np.array([features(t) for t in texts]))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype("int32"))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows that aren't held out."""
    held_out = fold(3) == 1
    model = train(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of docs, all columns, whose text is good (score >= 0.5)."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                scores = np.full(len(texts), model) if isinstance(model, float) else 1 / (1 + np.exp(-model.logits(np.array([features(t or "") for t in texts]))))
                yield part.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)
