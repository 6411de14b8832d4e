"""Loading, searching and recalling archives end to end, and the merge against a sequential model."""

import json
import random
import sqlite3
import zipfile

import pytest

from threadloom.cli import main
from threadloom.operators import merge
from threadloom.operators.evaluate import EvalCase, load_eval_cases, run_eval
from threadloom.operators.recall import rehearse
from threadloom.operators.search import search
from threadloom.plans.store import Store, index_source
from threadloom.sources.files import locate_export, resolve_adapter


def message(i, sender, text, at="2026-05-01T10:00:00Z", **more):
    return {"uuid": i, "sender": sender, "text": text, "created_at": at, **more}


def archive(first="a lighthouse keeper"):
    return [
        {"uuid": "alpha", "name": "Alpha talk", "chat_messages": [message("h1", "human", first), message("h2", "human", "and the harbour"), message("a1", "assistant", "The lamp turns slowly."), message("h3", "human", "海边的信仰")]},
        {"uuid": "beta", "name": "Beta talk", "chat_messages": [message("a2", "assistant", "An AI model replies"), message("h4", "human", " ", content=[{"type": "text", "text": "block of words"}, 7])]},
    ]


def write(folder, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "conversations.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return folder


def test_load_reload_edit(spark, tmp_path):
    index = tmp_path / "index"
    first = index_source(spark, write(tmp_path / "x", archive()), index)
    assert (first.conversations, first.messages, first.turns_seen, first.appended) == (2, 6, 4, 4)
    again = index_source(spark, tmp_path / "x", index)
    assert (again.appended, again.skipped, again.superseded) == (0, 4, 0)
    store = Store(spark, index)
    assert store.manifest().number == 0  # a load without changes commits nothing
    assert [r.turn_id for r in search(store.segments(), "lighthouse").collect()]
    assert search(store.segments(), "AI").count() == 1 and search(store.segments(), "信仰").count() == 1 and search(store.segments(), "AI model").count() == 1
    assert search(store.segments(), "block", role="human").count() == 1 and search(store.segments(), "block", role="assistant").count() == 0
    edited = index_source(spark, write(tmp_path / "x", archive("a windmill")), index)
    assert (edited.superseded, edited.skipped) == (1, 3)
    s = store.status()
    assert (s["schema_version"], s["rows_total"], s["active_turns"], s["superseded_turns"], s["conversations"], s["sources"]) == ("2", 5, 4, 1, 2, 1)
    assert search(store.segments(), "lighthouse").count() == 0
    block = rehearse(store.segments(), "windmill", token_budget=500)
    assert block.startswith("Archived recall for: windmill\n") and "[turn 0 |" in block and "[turn 1 |" in block
    assert rehearse(store.segments(), "zzzz").endswith("No archived hits found.")
    best = search(store.segments(), "windmill").first().turn_id
    report = run_eval(store.segments(), [EvalCase("windmill", (best,), 5), EvalCase("lamp", ("turn_x",))])
    assert report["hits"] == 1 and report["recall_at_k"] == 0.5 and len(report["misses"]) == 1
    for bad in ({"query": " "}, {"query": "lamp", "role": "system"}):
        with pytest.raises(ValueError):
            search(store.segments(), **bad)
    assert main(["--index", str(index), "status"], spark) == 0


def test_chat_log_splits_at_gaps(spark, tmp_path):
    t = 1778812851
    lines = [{"_type": "header", "meta": {"name": "Harbour"}}] + [{"_type": "message", "sender": s, "accountName": s.upper(), "timestamp": t + d, "type": k, "content": c, "platformMessageId": f"p{d}"} for s, d, k, c in (("a", 0, 0, "x"), ("b", 9, 0, ""), ("a", 309, 0, "y"), ("a", 610, 80, ""))]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "room.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, lines)), encoding="utf-8")
    adapter = resolve_adapter(tmp_path)
    assert adapter.name == "wechat"
    _, segments = adapter.load(spark, tmp_path)
    one, two = segments.orderBy("ordinal").collect()
    assert one.full_text == "x\n\ny" and [s.speaker_id for s in one.speaker_spans] == ["a", "b", "a"] and list(one.participants) == ["a"] and one.conv_title == "Harbour"
    assert two.full_text == "[system]" and one.ts == "2026-05-15T02:40:51Z"


def test_export_places(tmp_path):
    write(tmp_path / "in" / "deep", [])
    assert locate_export(tmp_path / "in").parent.name == "deep"
    write(tmp_path / "in" / "other", [])
    with pytest.raises(ValueError):
        locate_export(tmp_path / "in")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../conversations.json", "[]")
    with pytest.raises(ValueError):
        locate_export(tmp_path / "bad.zip")
    with pytest.raises(FileNotFoundError):
        locate_export(tmp_path / "nothing")


def test_eval_cases(tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"query": "x", "expected_turn_id": "t"}\n{"query": "y", "expected_turn_ids": ["t"], "k": 3}\n')
    assert [c.k for c in load_eval_cases(p)] == [None, 3]
    p.write_text("")
    assert load_eval_cases(p) == []
    p = tmp_path / "c.JSONL"  # any case; a case may expect nothing
    p.write_text('{"query": "x", "expected_turn_ids": []}\n\n{"query": "y", "expected_turn_id": ""}\n')
    assert [c.expected_turn_ids for c in load_eval_cases(p)] == [(), ("",)]
    (tmp_path / "c.json").write_text('[{"query": "x", "expected_turn_ids": ["a", "b"], "k": true}]')
    assert load_eval_cases(tmp_path / "c.json")[0].k == 1
    for bad in ({"query": ""}, {"query": "x"}, {"query": "x", "expected_turn_id": "t", "k": 0}, {"query": "x", "expected_turn_ids": None, "expected_turn_id": "t"}, {"query": "x", "expected_turn_ids": [1]}, [], {"query": "x", "expected_turn_id": "t", "k": 1.5}):
        p.write_text(json.dumps(bad) + "\n")
        with pytest.raises(ValueError):
            load_eval_cases(p)


def test_merge_is_the_sequential_one(spark):
    rng = random.Random(5)
    new, old, expected = [], [], {}
    kind = "source string, conv_uuid string, source_key string, content_hash string, msg_ids array<string>"
    for c in range(60):
        live, n = [], 0
        for _ in range(rng.randrange(4)):
            ids = sorted(rng.sample("abcdefgh", rng.randrange(1, 3)))
            if any(set(ids) & set(x[5]) for x in live):
                continue
            live.append((c * 100 + n, "s", f"c{c}", f"c{c}:" + ",".join(ids), rng.choice("xy"), ids))
            n += 1
        old += live
        state = {r[0]: r for r in live}
        for k in range(rng.randrange(4)):
            ids = sorted(rng.sample("abcdefgh", rng.randrange(1, 3)))
            row = (c * 100 + k, "s", f"c{c}", f"c{c}:" + ",".join(ids), rng.choice("xy"), ids)
            new.append(row)
            if any(r[3] == row[3] and r[4] == row[4] for r in state.values()):
                expected[row[0]] = ("skipped", set())
                continue
            stale = {i for i, r in state.items() if r[3] == row[3] or set(r[5]) & set(ids)}
            for i in stale:
                del state[i]
            state[("new", row[0])] = row
            expected[row[0]] = ("superseded" if stale else "appended", stale)
    found = merge.decide(spark.createDataFrame(new, "arrival long, " + kind), spark.createDataFrame(old, "id long, " + kind)).collect()
    assert {r.arrival: (r.action, {*r.retired, *(("new", x) for x in r.retired_new)}) for r in found} == expected


def test_bm25_is_that_of_an_independent_index(spark):
    texts = ["banana bandana band", "a band of bananas", "Straße STRASSE band", "nothing here", "ban the band band"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(full_text, human_text, assistant_text, tokenize='trigram')")
    rows = []
    for i, t in enumerate(texts, 1):
        db.execute("insert into f(rowid, full_text, human_text, assistant_text) values (?, ?, ?, ?)", (i, t, t[:9], t[9:]))
        rows.append((i, f"t{i}", "s", "s", "c", "C", "", 0, t[:9], t[9:], t))
    seg = spark.createDataFrame(rows, "id long, turn_id string, source string, source_id string, conv_uuid string, conv_title string, ts string, ordinal int, human_text string, assistant_text string, full_text string")
    for q in ("band", "ban ana", "STRA", "the band"):
        want = dict(db.execute("select rowid, -bm25(f) from f where f match ?", (" ".join(f'"{t}"' for t in q.split()),)).fetchall())
        got = {r.id: r.score for r in search(seg, q).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
