"""Language-model scoring by a hidden Markov model.

The counts of all training words (by 64-bit hash) are gathered by a shuffle and written as a
table. The ``SYMBOLS`` commonest words are the model's symbols, besides the text's end and one
symbol for all rarer words; a rarer word's probability is the states' probability of that
symbol times its add-one share among rarer words. Baum-Welch takes every training document as one sequence, whole:
it is cut into runs of ``RUN`` tokens that are worked on side by side, each run gives the products of its steps from every state
before it, and these are chained forwards and backwards, so that every run begins and ends with the vectors of its own document and
the expected counts are those of whole texts. Each partition adds up its expected counts, which are
summed by blocks of symbols, first by groups of partitions; the model itself has a bounded size. A whole text's likelihood is
exact: the same chain with double precision and logarithms.

Counts of at most ``KNOWN`` words are broadcast (a bound of 24 bytes each), all that occur more often than
some number; the rest of the corpus's words meet their counts in a join.

Defined results: a null or empty text is its end token alone; null and repeated doc_ids are scored row by row, and a null id
falls into the fold of the empty text; with no training rows N and V are 0, the base score is 0 and the model uniform; no rows
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, slices, text_column

STATES, SYMBOLS, KNOWN, RUN, ROUNDS = 8, 16_384, 1 << 18, 64, 5
#: Pseudo-counts by which a state's words lean on all states' words, and of each transition.
PRIOR, STEP_PRIOR = 200.0, 1.0
END = b" "  # no word holds a blank
_end = np.uint64(xxhash.xxh64_intdigest(END)).astype(np.int64)
PARTS = 32


def hashes(text: str) -> np.ndarray:
    """A hash for each word of a text and one for its end."""
    words = text.encode().lower().split()
    words.append(END)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


@dataclass
class Words:
    """Counts of the commonest words, and of all."""

    h: np.ndarray  # sorted
    count: np.ndarray
    symbol: np.ndarray  # 0: the end; 1: rarer words
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int
    symbols: int


def count_words(docs: DataFrame) -> DataFrame:
    """h, n: training words and how often they occur."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.concatenate([hashes(t) for t in part.column(0).to_pylist()])
                held.append(np.unique(x, return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_summed(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["h", "n"])
                        held = []
                    size = sum(len(h) for h, _ in held)
        if held:
            h, n = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select(text_column().alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _summed(parts):
    h, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    u, at = np.unique(h, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def commonest(counts: DataFrame, symbols: int = SYMBOLS, known: int = KNOWN) -> Words:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # a histogram of at most some thousand classes finds the least count that is still known: no task sorts all words
    kind = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("long")
    sizes = {r.kind: r["count"] for r in counts.groupBy(kind.alias("kind")).count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        if (held := held + sizes[k]) > known:
            break
        least = k
    top = counts.where(kind >= least).select("h", "n").toArrow()
    h, n = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    symbol = np.ones(len(h), np.int64)
    plain = np.flatnonzero(h != _end)[:symbols]
    symbol[plain] = np.arange(2, 2 + len(plain))
    symbol[h == _end] = 0
    ends = int(n[h == _end].sum())
    rare_tokens = int(total.n) - int(n[plain].sum()) - ends
    order = np.argsort(h)
    return Words(h[order], n[order], symbol[order], int(total.n), int(total.v), rare_tokens, int(total.v) - len(plain) - int(bool(ends)), 2 + len(plain))


def encoded(docs: DataFrame, held_out: Column, words: Words) -> DataFrame:
    """For each row a key, its symbols, what the known counts give, and the words that must meet their counts."""
    table = docs.sparkSession.sparkContext.broadcast(words)
    schema = "key long, doc_id long, held_out boolean, n_tokens long, rare long, known long, logs double, rare_logs double, symbols binary, other array<long>, times array<long>"

    def run(batches):
        w, at = table.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, out, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    h = hashes(text)
                    if len(w.h):
                        k = np.minimum(np.searchsorted(w.h, h), len(w.h) - 1)
                        hit = w.h[k] == h
                        c = np.where(hit, w.count[k], 0)
                        symbol = np.where(hit, w.symbol[k], 1)
                    else:
                        hit, c, symbol = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
                    symbol[-1] = 0
                    logs = np.log10(c + 1.0)
                    other, times = np.unique(h[~hit], return_counts=True)
                    rows.append((at, d, out, len(h), int((symbol == 1).sum()), int(hit.sum()), float(logs.sum()), float(logs[symbol == 1].sum()), symbol.astype("<u2").tobytes(), other, times))
                    at += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_column().alias("text")).mapInArrow(run, schema)


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbol, state

    def runs(self, sequences: list[np.ndarray]):
        """Runs of RUN symbols, longest first: symbols, lengths, whether first, sequence, and the order that sorted them."""
        o, size, first, of = [], [], [], []
        for k, x in enumerate(sequences):
            n = -(-len(x) // RUN)
            block = np.zeros(n * RUN, np.int64)
            block[: len(x)] = x
            o.append(block.reshape(n, RUN))
            s = np.full(n, RUN)
            s[-1] = len(x) - (n - 1) * RUN
            size.append(s)
            f = np.zeros(n, bool)
            f[0] = True
            first.append(f)
            of.append(np.full(n, k))
        o, size, first, of = (np.concatenate(x) for x in (o, size, first, of))
        order = np.argsort(-size, kind="stable")
        return o[order], size[order], first[order], of[order], order

    def _ends(self, o, size, first, of, order) -> tuple[np.ndarray, np.ndarray]:
        """For each run the state distribution before it (given what stands before), and in proportion the probability of what stands after it by its last state."""
        s, k = len(o), len(self.step)
        before, after = np.zeros((s, k), np.float32), np.ones((s, k), np.float32)
        if first.all():
            return before, after
        emit, step = self.emit.astype(np.float32), self.step.astype(np.float32)
        a = np.broadcast_to(np.where(first[:, None, None], self.start.astype(np.float32), step[None]), (s, k, k))
        through = np.zeros((s, k, k), np.float32)
        for t in range(RUN):
            n = int((size > t).sum())
            if not n:
                break
            a = (a[:n] if t == 0 else (a[:n].reshape(n * k, k) @ step).reshape(n, k, k)) * emit[o[:n, t]][:, None]
            if t % 4 == 3:
                # one factor for the whole run: its rows stay in proportion
                a /= a.max((1, 2), keepdims=True)
            through[:n] = a
        place = np.argsort(order)  # runs in the order of the texts
        through, text = through[place].astype(float), of[place]
        begin = np.searchsorted(text, np.arange(text[-1] + 1))
        many = np.diff(np.append(begin, s))
        rank = np.argsort(-many, kind="stable")
        begin, many = begin[rank], many[rank]
        norm = lambda x: x / x.sum(1, keepdims=True)
        v, w = through[begin, 0], np.ones((len(begin), k))
        left, right = np.zeros((s, k)), np.ones((s, k))
        for r in range(1, int(many.max())):
            n = int((many > r).sum())
            v = norm(v[:n])
            left[begin[:n] + r] = v
            v = np.einsum("ni,nij->nj", v, through[begin[:n] + r])
        for r in range(1, int(many.max())):
            n = int((many > r).sum())
            at = begin[:n] + many[:n] - r
            w = norm(np.einsum("nij,nj->ni", through[at], w[:n]))
            right[at - 1] = w
        before[:], after[:] = left[order], right[order]
        return before, after

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of emissions, of steps, and of first states."""
        o, size, first, of, order = self.runs(sequences)
        before, after = self._ends(o, size, first, of, order)
        emit, step = self.emit.astype(np.float32), self.step.astype(np.float32)
        s, k = len(o), len(step)
        live = [int((size > t).sum()) for t in range(RUN)]
        alpha, scale, seen = np.zeros((RUN, s, k), np.float32), np.ones((RUN, s), np.float32), []
        a = np.where(first[:, None], self.start.astype(np.float32), before @ step)
        for t in range(RUN):
            n = live[t]
            if not n:
                break
            seen.append(emit[o[:n, t]])
            a = (a[:n] if t == 0 else a[:n] @ step) * seen[t]
            scale[t, :n] = a.sum(1)
            a /= scale[t, :n, None]
            alpha[t, :n] = a
        last = alpha[size - 1, np.arange(s)]
        beta = after / (last * after).sum(1, keepdims=True)
        steps, counts = np.zeros((k, k)), np.zeros((len(emit), k))
        for t in range(len(seen) - 1, -1, -1):
            n = live[t]
            gamma = alpha[t, :n] * beta[:n]
            alpha[t, :n] = gamma / gamma.sum(1, keepdims=True)
            back = seen[t] * beta[:n] / scale[t, :n, None]
            # alpha[t - 1] still holds the forward vectors; before a first run there is no step
            steps += ((alpha[t - 1, :n] if t else before).T @ back) * step
            if t:
                beta[:n] = back @ step.T
        flat = np.concatenate([o[: live[t], t] for t in range(len(seen))])
        gammas = np.concatenate([alpha[t, : live[t]] for t in range(len(seen))])
        for j in range(k):
            counts[:, j] = np.bincount(flat, gammas[:, j], len(emit))
        return counts, steps, alpha[0][first].sum(0).astype(float)

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities of symbol sequences."""
        o, size, first, of, order = self.runs(sequences)
        s, k = len(o), len(self.step)
        a = np.broadcast_to(np.where(first[:, None, None], self.start[None, None], self.step[None]), (s, k, k))
        logs, final = np.zeros((s, k)), np.zeros((s, k, k))
        for t in range(RUN):
            n = int((size > t).sum())
            if not n:
                break
            a = (a[:n] if t == 0 else (a[:n].reshape(n * k, k) @ self.step).reshape(n, k, k)) * self.emit[o[:n, t]][:, None]
            c = a.sum(2)
            a = a / c[:, :, None]
            logs[:n] += np.log(c)
            final[:n] = a
        place = np.argsort(order)  # runs in the order of the texts
        logs, final, of = logs[place], final[place], of[place]
        begin = np.searchsorted(of, np.arange(len(sequences)))
        many = np.diff(np.append(begin, len(of)))
        rank = np.argsort(-many, kind="stable")
        v = final[begin[rank], 0]
        total = logs[begin[rank], 0].copy()
        for r in range(1, int(many.max(initial=0))):
            n = int((many > r).sum())
            at = begin[rank[:n]] + r
            top = logs[at].max(1)
            w = v[:n] * np.exp(logs[at] - top[:, None])
            x = np.einsum("ni,nij->nj", w, final[at])
            c = x.sum(1)
            v[:n] = x / c[:, None]
            total[:n] += np.log(c) + top
        out = np.zeros(len(sequences))
        out[rank] = total / np.log(10)
        return out


def begin(words: Words, states: int) -> Hmm:
    """Sticky steps, and emissions that are the corpus's, each word leaning to one state or another."""
    share = np.zeros(words.symbols)
    share[:2] = 1, words.rare_tokens + words.rare_types + 1
    np.maximum.at(share, words.symbol[words.symbol != 1], words.count[words.symbol != 1].astype(float))
    lean = np.random.default_rng(7).random((words.symbols, states)) * 2 + 0.2
    emit = share[:, None] * lean
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    even = np.full(states, 1 / states)
    return Hmm(even, step / step.sum(1, keepdims=True), emit / emit.sum(0))


def refined(model: Hmm, counts: np.ndarray, steps: np.ndarray, firsts: np.ndarray) -> Hmm:
    overall = counts.sum(1) + 0.5
    emit = counts + PRIOR * (overall / overall.sum())[:, None]
    step = steps + STEP_PRIOR
    return Hmm((firsts + 1) / (firsts + 1).sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _read(part: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in part.column(part.schema.get_field_index(column)).to_pylist()]


def _groups(sequences: list[np.ndarray], tokens: int = 150_000):
    at = held = 0
    for i, x in enumerate(sequences):
        held += len(x)
        if held >= tokens:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sequences):
        yield at, len(sequences)


def baum_welch(rows: DataFrame, model: Hmm) -> Hmm:
    """One round over all rows' symbols."""
    table = rows.sparkSession.sparkContext.broadcast(model)
    size, k = model.emit.shape

    def run(batches):
        m = table.value
        counts, steps, firsts = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            sequences = _read(batch, "symbols")
            for a, b in _groups(sequences):
                c, s, f = m.expected(sequences[a:b])
                counts += c
                steps += s
                firsts += f
        flat = np.concatenate((counts.ravel(), steps.ravel(), firsts.ravel()))
        salt = TaskContext.get().partitionId() % 64
        parts = np.array_split(flat, PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, salt, np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "salt", "x"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        x = sum(np.frombuffer(x) for x in rows["x"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "salt": rows["salt"].iloc[:1], "x": [x.tobytes()]})

    kind = "part int, salt int, x binary"
    summed = rows.select("symbols").mapInArrow(run, kind).groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    found = {r.part: np.frombuffer(r.x) for r in summed.collect()}  # the model's size, whatever the input
    if not found:
        return model
    flat = np.concatenate([found[i] for i in range(PARTS)])
    return refined(model, flat[: size * k].reshape(size, k), flat[size * k : size * k + k * k].reshape(k, k), flat[size * k + k * k :])


def score_documents(docs: DataFrame, held_out: Column | None = None, states: int = STATES, symbols: int = SYMBOLS, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    held_out = fold(7) == 2 if held_out is None else held_out
    counts = materialize(count_words(docs.where(~held_out)), "words")
    words = commonest(counts, symbols, known)
    rows = materialize(encoded(docs, held_out, words), "symbols")
    model = begin(words, states)
    for _ in range(rounds if words.tokens else 0):
        model = baum_welch(rows.where("not held_out"), model)
    table = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            sequences = _read(batch, "symbols")
            scores = np.concatenate([table.value.log10(sequences[a:b]) for a, b in _groups(sequences)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "hmm"])

    kept = ["key", "doc_id", "held_out", "n_tokens", "rare", "known", "logs", "rare_logs"]
    kinds = dict(rows.dtypes)
    scored = rows.select(*kept, "symbols").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", hmm double")
    other = rows.select("key", F.explode(F.arrays_zip("other", "times")).alias("x")).select("key", F.col("x.other").alias("h"), F.col("x.times").alias("times"))
    met = other.join(counts, "h").groupBy("key").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    base, rare = np.log10(words.tokens + words.types + 1), np.log10(words.rare_tokens + words.rare_types + 1)
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return scored.join(met, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("hmm") + F.col("rare_logs") + more_logs - F.col("rare") * float(rare)).alias("score"),
    )
