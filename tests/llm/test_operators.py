"""The operators against brute force, round trips and held-out rows, with odd rows."""

import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from threadloom.llm import components, licenses, lm, packing, quality, simhash, tokenfile, tokens, topk, toxicity, url_filter

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "one", "two words", "Ärger  über!\r\n straße…", "x " * 5000, "same text here again", "same text here again", "<|endoftext|> a\tb", "日本語 テスト 😀", "it's I'LL 12 ½ (z)?!"]


def documents(spark, texts, first=0):
    """With clashing columns that no operator may trip over."""
    rows = [(None if i == 1 else i + first, t, "en", "src", 0, "x", 1.0, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, held_out boolean")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rng, n, extra=()):
    words = [f"w{int(x)}" for x in rng.zipf(1.5, n) % 300]
    for e in extra:
        words.insert(int(rng.integers(len(words))), e)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    texts, rows = [], []
    for i in range(700):
        toxic, bad = i % 3 == 0, i % 4 == 0
        t = prose(rng, int(rng.integers(20, 90)), ("vilething", "slurword", "vilething") if toxic else ())
        texts.append(" ".join(w.upper() + "!!" for w in t.split()) if bad else t)
        rows.append((i, int(not bad), int(toxic)))
    texts += ODD
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string"), labels(spark, rows + [(None, 1, 1), (5, None, None)])


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, labelled, module, label):
    docs, marks = labelled
    p = module.score_documents(docs, marks).toPandas()
    assert len(p) == docs.count() and p.score.between(0, 1).all() and ((p.score >= 0.5) == (p.predicted == 1)).all()
    mod, left = (5, 0) if label == "toxic" else (3, 1)
    known = p[p.doc_id.notna()]
    assert [zlib.crc32(str(int(i)).encode()) % mod == left for i in known.doc_id] == list(known.held_out)
    both = known.merge(marks.toPandas().dropna(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[label]).mean() > 0.95
    none = module.score_documents(docs, marks.limit(0))
    assert {r.score for r in none.collect()} == {0.0}
    assert module.score_documents(docs.limit(0), marks).count() == 0


def fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, ids):
    at = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and at[i] != at[j]:
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    least = {}
    for i, c in zip(ids, at):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in at]


def test_simhash_is_brute_force(spark):
    rng = np.random.default_rng(2)
    base = prose(rng, 300)
    texts = [*ODD, *(prose(rng, 30) for _ in range(40)), *(base + f" tail{i % 6}" for i in range(25)), *(base.replace("w1 ", f"w{i} ", 1) for i in range(20))]
    docs = documents(spark, texts)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = [None if i == 1 else i for i in range(len(texts))]
    prints = [fingerprint(t) for t in texts]
    assert got == {(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, reachable(prints, ids))}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c in reachable(prints, ids)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 5, 20_000])
def test_trie_join_finds_every_link(spark, hot):
    rng = np.random.default_rng(hot)
    centers = rng.integers(0, 2**63, 6, dtype=np.uint64)
    found = {int(c) for c in centers}
    for c in centers:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(b)
            found.add(x)
    fps = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = simhash.trie_nodes(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    parts = components.components(simhash.trie_links(nodes)).collect()
    label = {r.node: r.component for r in parts}
    got = [label.get(x, x) for x in signed]
    want = reachable(fps, list(range(len(fps))))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_topk_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)) * 0.4, 1).astype("float32")
    x[50:120] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [1.0, None] * 4, 0), (1040, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (1060, [1.0], 0), (1080, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df, "vec_id % 20 = 0", candidates=64, queries=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    q = np.floor(64 * x.astype(float)).astype(int)
    want = {i: [(k, *t) for k, t in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:20], 1)] for i in range(0, 300, 20)}
    assert {k: sorted(v) for k, v in got.items()} == want
    big = topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert big[0].score == 2**63 - 1 or big[0].score == 64 * 10**9 * 64 * 10**9
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_url_rules(spark):
    urls = {
        "http://A.Example.NET/en/x": ("example.net/en/", "allow"), "http://example.net/enx": ("net/", "block"), "http://example.net": (None, "allow"), "https://x.example.com/de/": ("example.com/de/", "block"),
        "https://badexample.com/de/1": (None, "allow"), "http://a.org/fr/?q": ("org/fr/", "allow"), "ftp://net/": ("net/", "block"), "no scheme net/": (None, "allow"), "": (None, "allow"),
        "http://m.spam-farm.example.org/en/": (None, "block"), "http://x.org/casino/1": (None, "block"), "http://h.org/fr/casino/": ("org/fr/", "allow"), "http://x.com?u=http://example.net/en/": (None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)] * 2 + [(99, None, "x"), (None, "ftp://net/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = [(r.page_id, r["rule"], r.verdict, r.host, r.path) for r in url_filter.judge(df).collect()]
    assert len(got) == len(rows)
    names = list(urls)
    assert all(urls[names[i]] == (rule, verdict) for i, rule, verdict, _, _ in got if i is not None and i < 99)
    assert (99, None, "allow", "", "") in got and (0, "example.net/en/", "allow", "a.example.net", "/en/x") in got
    assert url_filter.judge(df.limit(0)).count() == 0
    long = "http://example.net/" + "a/" * 100_000 + "?q=" + "b" * 100_000
    many = spark.createDataFrame([(1, long, "x", "y")] * 3 + [(2, None, "x", "y")] * 3, "page_id long, url string, best string, verdict string")
    assert sorted((r.page_id, r["rule"] or "", r.verdict, len(r.path)) for r in url_filter.judge(many).collect()) == [(1, "net/", "block", 200_001)] * 3 + [(2, "", "allow", 0)] * 3


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_librarys_ids(path):
    rng = np.random.default_rng(4)
    e = tokens.Encoder(path)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list(" \n\t'.,!aAbBéßΣ日1²😀<|>$*"), 40)) for _ in range(800)]
    assert e.encode_all(texts) == [e._whole(t) for t in texts]


def ids_of(path, text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_token_file_round_trip(spark):
    docs = documents(spark, ODD)
    got = tokenfile.round_trip(docs, BYTES).collect()
    own = {i: ids_of(BYTES, t) for i, t in enumerate(ODD)}
    order = [1, 0, *range(2, len(ODD))]
    start, want = 0, set()
    for i in order:
        want.add((None if i == 1 else i, start, len(own[i]), zlib.crc32(own[i].tobytes())))
        start += len(own[i])
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert tokenfile.round_trip(docs.limit(0), BYTES).count() == 0
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in range(len(v) + 1):
        assert (tokenfile.unpack(*tokenfile.pack(v[:n]), n) == v[:n]).all()


def test_packing_places_every_piece(spark):
    texts = [*ODD, *(f"words number {i} " * (i % 40) for i in range(300))]
    got = packing.pack_documents(documents(spark, texts), WORDS, group=100).toPandas()
    want = Counter()
    for i, t in enumerate(texts):
        ids = ids_of(WORDS, t)
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(-1 if i == 1 else i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna({"doc_id": -1}).astype(int).itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([4, 4, 3, 3, 3, 3])
    assert len(packing.best_fit(lengths, 10)) == 3 and len(packing.pack(lengths, 10)) == 2
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = rng.integers(1, 60, 80)
        bins = packing.pack(n, 100)
        assert sorted(sum(bins, [])) == list(range(80)) and max(n[b].sum() for b in bins) <= 100 and len(bins) <= len(packing.best_fit(n, 100))


def test_lm_counts_and_likelihood(spark):
    rng = np.random.default_rng(8)
    texts = [*ODD, *(prose(rng, int(rng.integers(1, 300))) for _ in range(150))]
    got = lm.score_documents(documents(spark, texts), symbols=40, known=60, rounds=2, states=3).collect()
    ids = [None if i == 1 else i for i in range(len(texts))]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids]
    toks = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = {i: (h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, h, t in zip(ids, held, toks)}
    assert len(got) == len(texts)
    for r in got:
        h, size, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, size, known, total) and abs(r.base_score - base) < 1e-6 and r.score < 0
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_forward_recursion_is_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(9)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    m = lm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((4, 2)), 0))
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 9)]
    for s, got in zip(seqs, m.log10(seqs)):
        p = sum(m.start[z[0]] * m.emit[s[0], z[0]] * np.prod([m.step[a, b] * m.emit[o, b] for a, b, o in zip(z, z[1:], s[1:])]) for z in product((0, 1), repeat=len(s)))
        assert abs(got - math.log10(p)) < 1e-9
    long = [rng.integers(0, 4, 400), rng.integers(0, 4, 65)]
    for s, got in zip(long, m.log10(long)):
        a, total = m.start * m.emit[s[0]], 0.0
        for o in s[1:]:
            total += math.log(a.sum())
            a = (a / a.sum()) @ m.step * m.emit[o]
        assert abs(got - (total + math.log(a.sum())) / math.log(10)) < 1e-8


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(10)
    seqs = [rng.integers(0, 5, 60) + 5 * (i % 2) for i in range(40)]
    words = lm.Words(np.arange(8), np.full(8, 300), np.arange(2, 10), 2400, 8, 0, 0, 10)
    m = lm.begin(words, 2)
    lm_prior, lm.PRIOR = lm.PRIOR, 1.0
    scores = []
    for _ in range(6):
        scores.append(m.log10(seqs).sum())
        m = lm.refined(m, *m.expected(seqs))
    lm.PRIOR = lm_prior
    assert scores[-1] > scores[0] + 100 and all(b > a - 1 for a, b in zip(scores, scores[1:]))


def test_licence_sequences(spark):
    s = licenses.SENTENCES
    full = ". ".join(s[k] for k in ("apache-notice-you", "apache-copy", "apache-warranty", "apache-see")) + "."
    texts = [*ODD, "Prose.\nReleased under the  MIT License.\nmore", full.replace("you may not", "\nyou may not"), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0. " * 2, "all rights\nreserved!"]
    got = sorted(tuple(r) for r in licenses.scan(documents(spark, texts)).collect())
    n = len(ODD)
    assert got == [(n, "MIT", 1, 1), (n + 1, "Apache-2.0", 0, 4), (n + 2, "CC-BY-NC-4.0", 0, 1), (n + 3, "CC-BY-NC-4.0", 0, 1), (n + 3, "CC-BY-NC-4.0", 1, 1), (n + 4, "Proprietary", 0, 1)]
    assert licenses.scan(documents(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        n, docs = docs.count(), spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS) and 0.5 * n < docs.count() <= n
    assert json.dumps(docs.columns) and docs.count() > 0
