"""Exact search: rows that share an id, bounds carried over blocks, and where the bound stops."""

import numpy as np
import pytest

from threadloom.llm import topk


def search(x, q, own, k, floor=None, ids=None):
    lists = np.argsort(x, axis=0, kind="stable")
    ids = np.arange(len(x)) if ids is None else ids
    return topk.threshold_search(q, x, ids, lists, np.take_along_axis(x, lists, axis=0), own, k, floor)


def brute(x, q, own, k, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return sorted(((-s, i) for s, i, o in zip((x @ q).tolist(), ids.tolist(), own) if not o))[:k]


@pytest.mark.parametrize("seed", range(4))
def test_the_bound_stops_early_where_few_dimensions_count(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(4000, 12)) * 20 * 0.4 ** np.arange(12))
    early = 0
    for k in range(20):
        own = np.arange(4000) == k
        places, scores, scored = search(x, x[k], own, 10)
        assert [(-s, p) for s, p in zip(scores, places)] == brute(x, x[k], own, 10)
        early += scored < 2000
    assert early >= 15


def test_a_known_score_stops_earlier_and_loses_nothing():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(3000, 6)) * 20)
    q, own = x[0], np.arange(3000) == 0
    want = brute(x, q, own, 10)
    kth = -want[-1][0]
    _, _, alone = search(x, q, own, 10)
    for floor in (kth - 1, kth):
        places, scores, scored = search(x, q, own, 10, floor)
        assert [(-s, p) for s, p in zip(scores, places)] == want and scored <= alone
    places, _, scored = search(x, q, own, 10, kth + 1)
    assert [(-s, p) for s, p in zip((x @ q)[places], places)] == [w for w in want if -w[0] >= kth + 1]
    assert search(x, q, own, 10, 1e9)[2] < alone


@pytest.mark.parametrize("candidates", [16, 8192])
def test_rows_that_share_an_id(spark, candidates):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 5)), 1)
    ids = [20 if i % 3 == 0 else i for i in range(90)]
    rows = [(i, v.tolist(), 1, 2, "b") for i, v in zip(ids, x)] + [(40, [0.0] * 5, 1, 2, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, b int, p string")
    got = sorted((r.query_id, r["rank"], -r.score, r.vec_id) for r in topk.top_k(df, "vec_id % 20 = 0", k=7, candidates=candidates, queries=4).collect())
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(int)
    want = []
    for n, (i, *_) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-int(v[n] @ v[m]), rows[m][0]) for m in range(len(rows)) if m != n)[:7]
            want += [(i, rank, *t) for rank, t in enumerate(best, 1)]
    assert got == sorted(want)
