"""Near copies against brute force, by length and similarity."""

import numpy as np
import pytest

from threadloom.llm import nearcopies, simhash


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        if kind < 2:
            words[at : at + 1] = [f"e{int(rng.integers(10**9))}"] * (1 + kind)
        elif len(words) > 1:
            del words[at]
    return words


def similarity(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = cut(a.lower().split()), cut(b.lower().split())
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in nearcopies.keep_one(docs).collect()}


def least_of_components(texts):
    at = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if at[i] != at[j] and similarity(texts[i], texts[j]) >= 0.8:
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    return set(at)


@pytest.mark.parametrize("common", [1, 8])
def test_near_copies_are_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(nearcopies, "COMMON", common)
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(30)]
    texts = ["", " \n", "one", "One ", "a b c d", "a b c d e", "a  B c d"]
    for n in (6, 12, 24, 60, 300):
        for _ in range(12):
            base = [f"w{int(x)}" for x in rng.integers(0, 5000, n)]
            copies = [base, *(edited(rng, base, int(rng.integers(1, max(2, n // 30) + 1))) for _ in range(2))]
            texts += [" ".join(w) for w in copies]
            texts.append(" ".join([*base[: n // 2], *passage]))
    base = [f"h{i}" for i in range(150)]
    texts += [" ".join(edited(rng, base, 2)) for _ in range(60)]
    want = least_of_components(texts)
    assert len(want) < len(texts) - 60
    assert kept_ids(spark, texts) == want


def test_unlike_texts_do_not_link(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(edited(rng, base, 8))]
    assert 0.5 < similarity(*texts) < 0.8
    assert kept_ids(spark, texts) == {0, 1}


@pytest.mark.parametrize("few", [0, 1 << 18])
@pytest.mark.parametrize("module", [simhash, nearcopies])
def test_each_component_keeps_a_row(spark, monkeypatch, module, few):
    monkeypatch.setattr(simhash.kept_rows, "__defaults__", (few,))
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(7, a), (9, a), (7, b), (12, b), (None, c), (None, c)]
    kept = module.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(7, a), (7, b), (0, c)])


def test_short_near_copies_link(spark):
    texts = []
    for k, (n, more) in enumerate([(20, 2), (18, 1), (12, 1), (23, 0)]):
        base = [f"s{k}x{i}" for i in range(n)]
        texts += [" ".join(base), " ".join([*base, *(f"tail{i}" for i in range(more))] if more else [*base[:-1], "last"])]
    assert kept_ids(spark, texts) == {0, 2, 4, 6}


def test_parities_bound_what_sets_share():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.choice([1, 5, 40, 150, 600]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.choice([0.7, 0.9, 1.0])], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 2)), dtype=np.uint64) * np.uint64(2))))
        odd = np.bitwise_count(nearcopies.parities(a).view(np.uint64) ^ nearcopies.parities(b).view(np.uint64)).sum()
        assert odd <= len(np.setxor1d(a, b))
        assert nearcopies._sharing(len(a), len(b), int(odd)) or not nearcopies.alike(a, b)
