"""What the file formats accept, concurrent and incremental loads, older stores, and the tool server."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from threadloom import cli, server
from threadloom.operators.evaluate import EvalCase, eval_results, run_eval
from threadloom.operators.search import search, search_batch
from threadloom.plans import store as stores
from threadloom.plans.store import SCHEMA, Store, index_source
from threadloom.sources.files import ChatLogAdapter, ExportAdapter, locate_export
from threadloom.streaming.ingest import follow_messages

HEADER, NATIVE = {"_type": "header", "meta": {"name": " Room "}}, {"_type": "message", "sender": "a", "timestamp": 5, "platformMessageId": "p"}
PLAIN = {"_type": "message", "sender": "a", "timestamp": 6}


@pytest.mark.parametrize(
    "lines, fits",
    [
        ([NATIVE], True),
        ([PLAIN, NATIVE], True),  # the first message needn't be the one with an id
        ([PLAIN], False),
        ([HEADER], False),
        ([NATIVE, [1]], False),  # without a header, every line counts
        ([HEADER, NATIVE, [1]], True),
        ([HEADER, [1], NATIVE], False),
        ([NATIVE, HEADER, "x"], True),
        ([{}] * 49 + [NATIVE], True),
        ([{}] * 50 + [NATIVE], False),
    ],
)
def test_what_is_a_chat_log(tmp_path, lines, fits):
    (tmp_path / "room.jsonl").write_text("﻿" + "\n".join(map(json.dumps, lines)) + "\n", encoding="utf-8")
    assert ChatLogAdapter().detect(tmp_path) is fits


def test_chat_log_lines(spark, tmp_path):
    odd = [
        HEADER, {"_type": "header", "meta": {"name": "  "}}, {"_type": "header", "meta": 7}, NATIVE | {"content": " hé\r\nx  ", "accountName": 12}, 7, PLAIN | {"content": 3, "accountName": "", "type": 80},
        PLAIN | {"timestamp": "9"}, PLAIN | {"timestamp": 9.5}, PLAIN | {"sender": ""}, PLAIN | {"platformMessageId": "", "type": 7.0, "timestamp": 7}, {"_type": "member"},
    ]
    p = tmp_path / "my [room] 100%.JSONL"
    p.write_bytes(b"\xef\xbb\xbf" + "\r\n".join(json.dumps(x) for x in odd).encode() + b"\r\n\r\n")
    other = tmp_path / "texts"
    other.mkdir()
    (other / "empty+1.jsonl").write_text(json.dumps(NATIVE | {"sender": 5}))
    messages, segments = ChatLogAdapter().load(spark, p)
    got = [tuple(r) for r in messages.where("pos >= 0").orderBy("epoch", "pos").select("msg_id", "sender", "speaker_name", "text", "epoch", "kind", "conv_title").collect()]
    stem = "my [room] 100%"
    assert got == [("p", "a", "12", "hé\nx", 5, "text", "Room"), (f"{stem}:5", "a", "a", "", 6, "system", "Room"), (f"{stem}:9", "a", "a", "", 7, "rich", "Room")]
    assert [r.conv_uuid for r in segments.collect()] == [stem]
    # a log without a valid message is a conversation without segments
    stats = index_source(spark, tmp_path, tmp_path / "index")
    assert (stats.conversations, stats.messages, stats.turns_seen) == (1, 0, 0)


def test_export_faults(spark, tmp_path):
    p = tmp_path / "conversations.json"
    good = {"uuid": "c", "chat_messages": [{"uuid": "m", "sender": "human", "text": 5, "content": [{"type": "text", "text": "a"}, "x", {"type": "image", "text": "no"}, {"type": "text", "text": " "}, {"type": "text", "text": "b"}]}, 3, {"uuid": "n", "sender": "tool", "text": "t"}]}
    p.write_text(json.dumps([good, {"uuid": "d", "chat_messages": {}}, {"uuid": "e", "name": None}]))
    messages, segments = ExportAdapter().load(spark, p)
    assert messages.where("pos = -1").count() == 3
    assert [(r.full_text, r.conv_title, r.ts) for r in segments.collect()] == [("a\n\nb", "", "")]
    stats = index_source(spark, p, tmp_path / "index")
    assert (stats.conversations, stats.messages, stats.turns_seen) == (3, 1, 1)
    p.write_text(json.dumps(good))
    with pytest.raises(ValueError):
        ExportAdapter().load(spark, p)
    for bad in ([7], [{"name": "x"}], [{"uuid": ""}], [{"uuid": "c", "chat_messages": [{"uuid": "m"}]}], [{"uuid": "c", "chat_messages": [{"sender": "human"}]}]):
        p.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="without|MALFORMED"):
            ExportAdapter().load(spark, p)


def test_archives_are_unpacked_beside_themselves_and_removed(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("deep/conversations.json", json.dumps([{"uuid": "c", "chat_messages": [{"uuid": "m", "sender": "human", "text": "t"}]}]))
    _, segments = ExportAdapter().load(spark, tmp_path / "x.zip")
    assert segments.count() == 1 and [x.name for x in tmp_path.iterdir()] == ["x.zip"]
    assert locate_export(tmp_path / "x.zip", str(tmp_path / "own")).is_file()


def rows(spark, conv, n, text="t"):
    data = [(f"{conv}{i}", "claude", conv, f"k{conv}{i}", f"h{text}{i}", [f"m{i}"], conv, "T", "", i, f"{text}{i}", "", f"{text}{i}", ord(conv) * 100 + i) for i in range(n)]
    return spark.createDataFrame(data, "turn_id string, source string, source_id string, source_key string, content_hash string, msg_ids array<string>, conv_uuid string, conv_title string, ts string, ordinal int, human_text string, assistant_text string, full_text string, arrival long")


def test_of_two_loads_that_began_together_none_is_lost(spark, tmp_path):
    path = tmp_path / "s"
    Store(spark, path).upsert(rows(spark, "a", 2))
    both = threading.Barrier(2)

    class Slow(Store):
        waited = False

        def _publish(self, new):
            if not self.waited:
                self.waited = True
                both.wait(120)
            super()._publish(new)

    found = {}
    ts = [threading.Thread(target=lambda c=c: found.update({c: Slow(spark, path).upsert(rows(spark, c, 3)).first().appended})) for c in ("b", "c")]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert found == {"b": 3, "c": 3} and Store(spark, path).manifest().number == 2
    own = Store(spark, path).segments()
    assert own.groupBy("conv_uuid").count().count() == 3 and own.select("id").distinct().count() == own.count() == 8
    stale = Store(spark, path).manifest()
    stale.number = 2
    with pytest.raises(stores.Conflict):
        Store(spark, path)._publish(stale)


def test_only_the_conversations_of_a_load_are_written_anew(spark, tmp_path):
    s = Store(spark, tmp_path / "s")
    s.upsert(rows(spark, "a", 2).unionByName(rows(spark, "b", 2)).unionByName(rows(spark, "c", 2)))
    before = s.manifest().parts
    s.upsert(rows(spark, "b", 2, "u").withColumn("turn_id", F.concat("turn_id", F.lit("x"))))
    after = s.manifest().parts
    assert sum(before[k] != after[k] for k in before) == 1
    assert {r.conv_uuid: r["count"] for r in s.segments().where("active").groupBy("conv_uuid").count().collect()} == {"a": 2, "b": 2, "c": 2}
    assert s.status() == {"schema_version": "2", "rows_total": 8, "active_turns": 6, "superseded_turns": 2, "conversations": 3, "sources": 1}
    (tmp_path / "s" / "manifests" / "00000009").write_text("{")  # still being written
    assert s.manifest().number == 1


def test_an_older_store_is_filled_and_written_anew(spark, tmp_path):
    path = tmp_path / "s"
    s = Store(spark, path)
    s.upsert(rows(spark, "a", 2))
    old = s.segments().drop("source_id", "ts_start", "ts_end").withColumn("bucket", stores.bucket())
    old.write.partitionBy("bucket").parquet(f"{path}/old")
    s._publish(stores.Manifest(1, "1", 2, dict.fromkeys(s.manifest().parts, "old")))
    assert s.status()["schema_version"] == "1" and {r.source_id for r in s.segments().collect()} == {"a"}
    assert s.upsert(rows(spark, "a", 2)).first().skipped == 2
    assert s.status()["schema_version"] == "2" and s.segments().count() == 2
    s._publish(stores.Manifest(3, "3"))
    with pytest.raises(ValueError):
        s.segments()


def test_empty_requests(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert search_batch(empty, []).collect() == [] and eval_results(empty, []).collect() == []
    assert run_eval(empty, []) == {"cases": 0, "hits": 0, "recall_at_k": 0.0, "misses": []}
    assert run_eval(empty, [EvalCase("x y z", ())])["misses"] == [{"query": "x y z", "k": 10, "expected_turn_ids": [], "returned_turn_ids": []}]
    assert search(empty, "abc", limit=-1).collect() == []


def test_a_stream_in_pieces(spark, tmp_path):
    kind = "source string, conv_uuid string, conv_title string, conv_pos long, pos long, msg_id string, sender string, text string, ts string"

    def said(*turns):
        return spark.createDataFrame([("claude", "c", "C", 0, i, f"m{i}", who, text, "") for i, who, text in turns], kind)

    store, source = Store(spark, tmp_path / "s"), tmp_path / "in"

    def follow(df):
        df.coalesce(1).write.mode("append").parquet(str(source))
        follow_messages(spark.readStream.schema(kind).parquet(str(source)), store, str(tmp_path / "checkpoint")).awaitTermination()
        return [(r.ordinal, r.full_text) for r in store.segments().where("active").orderBy("ordinal").collect()]

    assert follow(said((0, "human", "a"), (1, "assistant", "b"))) == [(0, "a\n\nb")]
    # the conversation goes on in a later piece, and its turns with it
    assert follow(said((2, "human", "c"), (3, "assistant", "d"))) == [(0, "a\n\nb"), (1, "c\n\nd")]
    assert follow(said((4, "assistant", "e"))) == [(0, "a\n\nb"), (1, "c\n\nd\n\ne")]
    assert follow(said((0, "human", "A"))) == [(0, "A\n\nb"), (1, "c\n\nd\n\ne")]


def test_tool_server(spark, tmp_path):
    Store(spark, tmp_path / "s").upsert(rows(spark, "a", 3, "word "))

    class Fake:
        def __init__(self, name):
            self.tools = {}

        def tool(self, name, description):
            return lambda f: self.tools.setdefault(name, f)

    made = server.create_server(spark, tmp_path / "s", Fake)
    assert set(made.tools) == {"search", "search_chat_history"}
    assert len(json.loads(made.tools["search"]("word", limit=2))) == 2
    assert made.tools["search_chat_history"]("word", token_budget=500).startswith("Archived recall for: word\n")
    try:
        import mcp  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(RuntimeError):
            cli.main(["--index", str(tmp_path / "s"), "serve"], spark)
