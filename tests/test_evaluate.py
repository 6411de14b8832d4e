"""Cases share their scans whatever their k, and what was made faster gives the results of plain Python."""

import re

from pyspark.sql import functions as F

from threadloom.functions.text import ascii_fold, fold, fold_term, normalize_text, occurrences
from threadloom.operators import evaluate
from threadloom.operators.assemble import turns
from threadloom.operators.search import search_batch
from threadloom.sources.tabular import conversation_messages


def segments(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{'aaaa ' * (c % 3)}the lamp {c} {'Straße İstanbul ' * t}  \r\n") for c in range(12) for t in range(4)] + [(20, 0, "user", None), (20, 1, "user", " ")]
    out = turns(conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    return out.withColumn("id", F.xxhash64("turn_id"))


def test_one_scan_for_cases_of_any_k(spark, monkeypatch):
    seg = segments(spark)
    queries, ks = ["the lamp", "aaa", "straße la", "a", "nothing", "la th"], [1, 7, None, 3, 2, 100]
    best = {q: [r.turn_id for r in search_batch(seg, [("q", q)], 100).orderBy("rank").collect()] for q in queries}
    cases = [evaluate.EvalCase(q, (best[q][3],) if len(best[q]) > 3 else ("turn_x",), k) for q, k in zip(queries, ks)]
    calls = []
    monkeypatch.setattr(evaluate, "search_batch", lambda *a, **k: calls.append(a) or search_batch(*a, **k))
    found = evaluate.eval_results(seg, cases, 5).orderBy("case").collect()
    assert len(calls) == 1
    assert [(r.query, r.k, r.returned) for r in found] == [(q, k or 5, best[q][: k or 5]) for q, k in zip(queries, ks)]
    assert [r.hit for r in found] == [set(c.expected_turn_ids) <= set(best[c.query][: c.k or 5]) for c in cases]
    assert len(best["aaa"]) == 16 and len(best["the lamp"]) == 24


def test_counts_and_folds(spark):
    texts = ["", "aaaaa", "ababab the theta\nthe", "ΑΣ ας µſͅϐ ẛ ι", "İİİx iİi", "THE É Straße ẞ K", "🦊🦊🦊 the 🦊🦊", "plain ASCII Only", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    terms = ["aaa", "abab", "the", "Straße", "🦊🦊🦊", "ας ", "İİİ", "only", "x.y", "\\E.Q"]
    got = df.select("t", fold(F.col("t")).alias("f"), ascii_fold(F.col("t")).alias("a"), *(occurrences(fold(F.col("t")), fold_term(x)).alias(f"n{k}") for k, x in enumerate(terms))).collect()
    for r in got:
        if r.t is None:
            assert r.f is None and r.a is None
            continue
        assert r.a == "".join(x.lower() if "A" <= x <= "Z" else x for x in r.t)
        assert [r[f"n{k}"] for k in range(len(terms))] == [len(re.findall(f"(?={re.escape(fold_term(x))})", r.f)) for x in terms], r.t
        assert r.f == fold_term(r.t) or "Σ" in r.t


def test_texts_of_turns_are_in_normal_form(spark):
    for c in ("human_text", "assistant_text", "full_text"):
        assert segments(spark).where(F.col(c) != normalize_text(F.col(c))).count() == 0
