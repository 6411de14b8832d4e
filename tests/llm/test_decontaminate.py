"""Decontamination against brute force over all windows, and what the multi-index finds."""

from collections import Counter

import numpy as np

from threadloom.llm import decontaminate
from threadloom.llm.decontaminate import RADIUS, SHINGLE

from test_operators import ODD, documents, prose


def bag(words):
    width = min(SHINGLE, len(words))
    return Counter(zip(*(words[i:] for i in range(width)))) if width else Counter()


def bags_similarity(a, b):
    a, b = bag(a), bag(b)
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        words[at : at + (kind != 0)] = [f"e{int(rng.integers(10**6))}"] * (kind != 2)
    return words


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(7)
    items = [" ".join(f"q{int(x)}" for x in rng.integers(0, 60, n)) for n in (12, 25, 60, 3, 5)] + [None, ""]
    long = items[2].split()
    texts = [*ODD, *(prose(rng, 80) for _ in range(10)), "a " * 9 + items[0].upper() + ". more", items[1], "x " + " ".join(long[:30] + ["added"] + long[30:]) + " y", " ".join(long[:30]), "before " + items[3] + " after", items[4] + "!"]
    docs, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = lambda t: decontaminate._words((t or "").lower())
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        for k, item in enumerate(map(words, items)):
            n = min(len(item), len(w))
            if item and n:
                best = max(bags_similarity(w[s : s + n], item) for s in range(len(w) - n + 1))
                if best >= 0.8:
                    want.add((None if i == 1 else i, k, round(best, 9)))
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.matches(docs, bench, block=60).collect()}
    assert got == want and len({k for _, k, _ in want}) == 5
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(texts) - len({i for i, _, _ in want})
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0


def test_the_multi_index_finds_all_within_the_radius_and_selects():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 60))) for k in range(400)])
    looked_at = []
    for k in range(0, 400, 8):
        for bits in (0, 8, 20, RADIUS):
            p = index.prints[k].copy()
            for at in rng.choice(128, bits, replace=False).tolist():
                p[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
            far = np.bitwise_count(index.prints ^ p).sum(1)
            assert index.within(p).tolist() == np.flatnonzero(far <= RADIUS).tolist() and k in index.within(p)
        near = np.zeros(400, bool)
        for b, v in enumerate(decontaminate._parts(p)):
            near |= np.isin(decontaminate._parts(index.prints)[:, b], v ^ decontaminate._MASKS)
        looked_at.append(near.mean())
    assert np.mean(looked_at) < 0.15


def test_edited_items_are_found():
    """Recall of RADIUS and SLACK over texts that hold a window of similarity 0.8 or more."""
    rng = np.random.default_rng(3)
    caught = missed = 0
    for _ in range(250):
        n = int(rng.choice([8, 20, 50, 120]))
        item = [f"w{int(x)}" for x in rng.integers(0, 400, n)]
        own = edited(rng, item, int(rng.integers(0, max(2, n // 20))))
        words = [f"v{int(x)}" for x in rng.integers(0, 400, 15)] + own + [f"u{int(x)}" for x in rng.integers(0, 400, 15)]
        best = max(bags_similarity(words[s : s + n], item) for s in range(len(words) - n + 1))
        found = decontaminate.Index([(1, " ".join(item))]).matches(" ".join(words))
        assert bool(found) <= (best >= 0.8) and all(abs(m[4] - best) < 1e-9 for m in found if m[4] < best - 0.05)
        caught += best >= 0.8 and bool(found)
        missed += best >= 0.8 and not found
    assert caught > 120 and missed / (caught + missed) < 0.01


def test_repeated_ids_and_very_long_texts(spark):
    item = "the quick brown fox jumps over one lazy dog today"
    long = "filler " * 200_000 + item + " filler" * 200_000
    docs = spark.createDataFrame([(1, item, 5), (1, "nothing here at all", 5), (1, item, 5), (2, long, 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (9, "another thing that nobody says in any of these"), (None, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.similarity) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted([(1, 9, 1.0), (1, 0, 1.0)] * 2 + [(2, 9, 1.0), (2, 0, 1.0)])
    assert [r.text for r in decontaminate.clean(docs, bench).collect()] == ["nothing here at all"]
