"""Baum-Welch and the final score against plain recursions over whole texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from threadloom.llm import lm


def forward_backward(m, x):
    """Expected counts of one sequence."""
    n, k = len(x), len(m.step)
    a, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.step) * m.emit[x[t]]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.step @ (m.emit[x[t + 1]] * b[t + 1]) / c[t + 1]
    counts, steps = np.zeros(m.emit.shape), np.zeros((k, k))
    for t in range(n):
        counts[x[t]] += a[t] * b[t]
        if t:
            steps += np.outer(a[t - 1], m.emit[x[t]] * b[t] / c[t]) * m.step
    return counts, steps, a[0] * b[0], np.log10(c).sum()


def model(rng, symbols, states):
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return lm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)) + 3 * np.eye(states), 1), norm(rng.random((symbols, states)) ** 4, 0))


@pytest.mark.parametrize("lengths", [[1, 2, 64, 65, 128, 129, 700], [5], [3000, 1], [64] * 3])
def test_expected_counts_are_those_of_whole_texts(lengths):
    rng = np.random.default_rng(len(lengths))
    m = model(rng, 30, 5)
    texts = [rng.integers(0, 30, n) for n in lengths]
    got = m.expected(texts)
    for x, y in zip(got, (sum(p) for p in zip(*(forward_backward(m, t)[:3] for t in texts)))):
        assert np.allclose(x, y, rtol=2e-3, atol=2e-3)
    assert math.isclose(got[0].sum(), sum(lengths), rel_tol=1e-4) and math.isclose(got[1].sum(), sum(n - 1 for n in lengths), rel_tol=1e-4, abs_tol=1e-6)


def test_scores_are_those_of_a_plain_model(spark):
    rng = np.random.default_rng(12)
    texts = [None, "", "A a B", "tie tie tie"] + [" ".join(f"w{int(x) % 50}" for x in rng.zipf(1.4, int(rng.integers(1, 200)))) for _ in range(60)]
    ids = [3, 3, None, *range(10, 10 + len(texts) - 3)]
    rows = [(i, t, 1, "h", 0.5) for i, t in zip(ids, texts)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, n long, h string, hmm double"), states=3, symbols=20, known=30, rounds=2).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    c = Counter(w for i, t in zip(ids, tokens) if not held(i) for w in t)
    # the commonest words are symbols; the model may only know words above a count that at most 30 have
    counts = Counter(c.values())
    least = min((n for n in counts if sum(v for m, v in counts.items() if m >= n) <= 30), default=max(counts) + 1)
    signed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64))
    known = sorted((w for w in c if c[w] >= least and w != b" "), key=lambda w: (-c[w], signed(w)))[:20]
    symbol = {w: k for k, w in enumerate(known, 2)} | {b" ": 0}
    rare_tokens, rare_types = (sum(f(n) for w, n in c.items() if w not in symbol) for f in (int, bool))
    h = np.array([lm._end, *map(signed, known)])
    words = lm.Words(h, np.array([c[b" "], *(c[w] for w in known)]), np.array([0, *range(2, 2 + len(known))]), sum(c.values()), len(c), rare_tokens, rare_types, 2 + len(known))
    m = lm.begin(words, 3)
    coded = [np.array([symbol.get(w, 1) for w in t]) for t in tokens]
    for _ in range(2):
        parts = [forward_backward(m, x)[:3] for i, x in zip(ids, coded) if not held(i)]
        m = lm.refined(m, *(sum(p) for p in zip(*parts)))
    want = []
    for i, t, x in zip(ids, tokens, coded):
        rare = sum(math.log10((c[w] + 1) / (rare_tokens + rare_types + 1)) for w in t if w not in symbol)
        want.append((i or 0, len(t), forward_backward(m, x)[3] + rare))
    for (i, n, score), (j, k, expected) in zip(sorted((r.doc_id or 0, r.n_tokens, r.score) for r in got), sorted(want)):
        assert (i, n) == (j, k) and abs(score - expected) < 1e-3 * max(1, abs(expected))
