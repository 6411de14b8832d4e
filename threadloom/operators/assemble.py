"""Messages to segments: turns of an export, sessions of a chat log.

Messages: source, conv_uuid, conv_title, pos (place in the conversation), msg_id, sender,
speaker_name, text (normal form), ts (ISO text), kind.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256, stable_json, turn_text

GAP_SECONDS = 300
SLICE_SECONDS = 86_400
KINDS = {80: "system", 7: "rich", 4: "file", 25: "reply", 99: "transfer"}
SEGMENT_COLUMNS = (
    "turn_id", "source", "source_id", "source_key", "content_hash", "source_msg_ids", "msg_ids", "conv_uuid", "conv_title", "ts", "ts_start", "ts_end",
    "ordinal", "human_text", "assistant_text", "full_text", "speaker_spans", "participants", "media_refs",
)


def kind_of(code: Column) -> Column:
    out = F.lit("text")
    for k, name in KINDS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def iso_from_epoch(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _identified(df: DataFrame) -> DataFrame:
    """Adds what follows from msgs (an ordered array with msg_id) and full_text."""
    ids = F.transform("msgs", lambda m: F.array(F.col("conv_uuid"), m.msg_id))
    df = df.withColumn("source_msg_ids", stable_json(ids)).withColumn("msg_ids", F.col("msgs.msg_id"))
    df = df.withColumn("source_key", sha256(F.col("source_msg_ids"))).withColumn("content_hash", sha256(F.col("full_text")))
    return (
        df.withColumn("turn_id", F.concat(F.lit("turn_"), F.substring("source_key", 1, 24)))
        .withColumn("source_id", F.col("conv_uuid"))
        .withColumn("media_refs", F.array().cast("array<string>"))
        .select(*SEGMENT_COLUMNS)
    )


def _joined(parts: Column) -> Column:
    """Texts in normal form as one, which is in normal form too."""
    return F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")


def turn_ordinals(messages: DataFrame) -> DataFrame:
    """Numbers turns: one begins at the first message and at each human one after an assistant one."""
    w = Window.partitionBy("source", "conv_uuid").orderBy("pos")
    own = messages.where(F.col("sender").isin("human", "assistant"))
    before = F.lag("sender").over(w)
    begins = before.isNull() | ((F.col("sender") == "human") & (before == "assistant"))
    return own.withColumn("begins", begins.cast("int")).withColumn("ordinal", (F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("begins")


def turns(messages: DataFrame) -> DataFrame:
    """Segments of human runs, each with the assistant run after it."""
    msg = F.struct("pos", "msg_id", "sender", "text", "ts")
    grouped = turn_ordinals(messages).groupBy("source", "conv_uuid", "ordinal").agg(F.sort_array(F.collect_list(msg)).alias("msgs"), F.first("conv_title").alias("conv_title"))

    def said(role):
        return _joined(F.transform(F.filter("msgs", lambda m: m.sender == role), lambda m: m.text))

    out = grouped.withColumn("human_text", said("human")).withColumn("assistant_text", said("assistant"))
    out = out.withColumn("full_text", turn_text(F.col("human_text"), F.col("assistant_text")))
    first = F.coalesce(F.get(F.filter(F.col("msgs.ts"), lambda t: t != ""), F.lit(0)), F.lit(""))
    out = out.withColumn("ts", first).withColumn("ts_start", F.col("ts")).withColumn("ts_end", F.col("ts"))

    def span(role, name, text):
        return F.struct(F.lit(role).alias("speaker_id"), F.lit(name).alias("speaker_name"), F.col(text).alias("text"))

    out = out.withColumn("speaker_spans", F.array(span("human", "Human", "human_text"), span("assistant", "Assistant", "assistant_text")))
    spoken = F.filter("speaker_spans", lambda s: s.text != "")
    return _identified(out.withColumn("participants", F.array_distinct(F.transform(spoken, lambda s: s.speaker_id))))


def session_ordinals(messages: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Numbers sessions: one begins where more than gap seconds passed since the message before. messages: also epoch (whole seconds).

    A conversation is numbered in slices of time, each by itself, so that a long one isn't one task's; what the slices before add comes from
    a row for each slice.
    """
    own = ("source", "conv_uuid", "slice")
    w = Window.partitionBy(*own).orderBy("epoch", "pos")
    begins = F.coalesce(F.col("epoch") - F.lag("epoch").over(w) > gap, F.lit(False)).cast("int")
    sliced = messages.withColumn("slice", F.floor(F.col("epoch") / SLICE_SECONDS)).withColumn("begins", begins)
    sliced = sliced.withColumn("within", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    slices = sliced.groupBy(*own).agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.max("within").alias("n"))
    v = Window.partitionBy("source", "conv_uuid").orderBy("slice")
    opens = F.coalesce(F.col("first") - F.lag("last").over(v) > gap, F.lit(False)).cast("int")
    slices = slices.withColumn("opens", opens).select(*own, (F.sum(F.col("opens") + F.col("n")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return sliced.join(slices, list(own)).withColumn("ordinal", (F.col("before") + F.col("within")).cast("int")).drop("slice", "within", "before")


def spans(messages: DataFrame) -> DataFrame:
    """Sessions' messages to (source, conv_uuid, ordinal, span, speaker_id, speaker_name, text, msgs): runs of one speaker."""
    w = Window.partitionBy("source", "conv_uuid", "ordinal").orderBy("epoch", "pos")
    begins = F.coalesce(F.col("sender") != F.lag("sender").over(w), F.lit(False)).cast("int")
    run = messages.withColumn("begins", begins).withColumn("span", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    msg = F.struct("epoch", "pos", "msg_id", "speaker_name", "text", "ts", "kind")
    out = run.groupBy("source", "conv_uuid", "conv_title", "ordinal", "span", F.col("sender").alias("speaker_id")).agg(F.sort_array(F.collect_list(msg)).alias("msgs"))
    return out.withColumn("speaker_name", F.col("msgs")[0].speaker_name).withColumn("text", _joined(F.col("msgs.text")))


def sessions(messages: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Segments of messages with no longer pause than gap."""
    span = F.struct("span", "speaker_id", "speaker_name", "text", "msgs")
    out = spans(session_ordinals(messages, gap)).groupBy("source", "conv_uuid", "conv_title", "ordinal").agg(F.sort_array(F.collect_list(span)).alias("s"))
    out = out.withColumn("msgs", F.flatten("s.msgs")).withColumn("speaker_spans", F.transform("s", lambda s: F.struct(s.speaker_id.alias("speaker_id"), s.speaker_name.alias("speaker_name"), s.text.alias("text"))))
    full = _joined(F.col("s.text"))
    kinds = F.array_join(F.transform("msgs", lambda m: F.concat(F.lit("["), m.kind, F.lit("]"))), "\n\n")
    out = out.withColumn("full_text", F.when(full == "", kinds).otherwise(full)).withColumn("ts", F.col("msgs")[0].ts)
    out = out.withColumn("ts_start", F.col("ts")).withColumn("ts_end", F.element_at("msgs.ts", -1))

    def said(role):
        return F.array_join(F.transform(F.filter("speaker_spans", lambda s: (s.speaker_id == role) & (s.text != "")), lambda s: s.text), "\n\n")

    out = out.withColumn("human_text", said("human")).withColumn("assistant_text", said("assistant"))
    spoken = F.filter("speaker_spans", lambda s: s.text != "")
    return _identified(out.withColumn("participants", F.array_distinct(F.transform(spoken, lambda s: s.speaker_id))))


class _Digest:
    """One session's messages, taken in order; only its speakers are held."""

    def __init__(self, key: tuple):
        self.key, self.messages, self.speakers = key, 0, {}
        self.ids, self.texts, self.kinds = hashlib.sha256(b"["), None, None

    def add(self, ids: list, senders: list, texts: list, times: list, kinds: list) -> None:
        if not self.messages:
            self.start = times[0]
        self.ids.update((b"," if self.messages else b"") + ",".join(ids).encode())
        self.messages, self.end = self.messages + len(ids), times[-1]
        if said := [t for t in texts if t]:
            self.texts = self._joined(self.texts, said)
            self.speakers |= dict.fromkeys(s for s, t in zip(senders, texts) if t and s is not None)
        if not self.texts:
            self.kinds = self._joined(self.kinds, [f"[{k}]" for k in kinds if k is not None])

    @staticmethod
    def _joined(done, parts: list):
        out = done or hashlib.sha256()
        out.update((b"\n\n" if done and parts else b"") + "\n\n".join(parts).encode())
        return out if done or parts else None

    def row(self) -> tuple:
        self.ids.update(b"]")
        full = self.texts or self.kinds or hashlib.sha256()
        return *self.key, self.start, self.end, self.messages, f"turn_{self.ids.hexdigest()[:24]}", full.hexdigest(), list(self.speakers)


def session_digests(messages: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """What sessions gives of each session but the texts and lists: its times, number of messages, turn_id, content_hash and participants.

    Messages are sorted by Spark, which spills, and hashed one after another, so that a session of any length takes no more memory than its speakers.
    """
    own = ("source", "conv_uuid", "conv_title", "ordinal")
    types = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [*own, "ts_start", "ts_end", "messages", "turn_id", "content_hash", "participants"]

    def run(batches):
        held = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*columns[: len(own)]))
            done = []
            for key, places in groupby(range(len(keys)), keys.__getitem__):
                places = list(places)
                if held is None or held.key != key:
                    done += [held.row()] if held else []
                    held = _Digest(key)
                held.add(*(c[places[0] : places[-1] + 1] for c in columns[len(own) :]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held.row(), types)], names)

    rows = session_ordinals(messages, gap).select(*own, "epoch", "pos", "msg_id", "sender", "text", "ts", "kind")
    rows = rows.repartition(*own).sortWithinPartitions(*own, "epoch", "pos", "msg_id")
    rows = rows.select(*own, stable_json(F.array("conv_uuid", "msg_id")).alias("id"), "sender", "text", "ts", "kind")
    return rows.mapInArrow(run, "source string, conv_uuid string, conv_title string, ordinal int, ts_start string, ts_end string, messages int, turn_id string, content_hash string, participants array<string>")
