"""Conversations and events that are tables already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed, normalize_text
from ..operators.assemble import iso_from_epoch, kind_of


def conversation_messages(rows: DataFrame, text: Column | None = None, msg_id: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text to messages; user is human, and other roles than user and assistant are left out later."""
    day = F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp"))
    out = rows.select(
        F.lit("claude").alias("source"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_uuid"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("conv_title"),
        F.col("turn").cast("long").alias("pos"),
        (F.concat(F.lit("m"), F.col("turn").cast("string")) if msg_id is None else msg_id).alias("msg_id"),
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"),
        composed(F.col("text") if text is None else text).alias("text"),
        iso_from_epoch(day + F.col("conv_id") * 86400 + F.col("turn")).alias("ts"),
    )
    # turns need conversations together anyway; brought together here, a table of few files is normalised by all tasks
    return out.repartition("conv_uuid").withColumn("text", normalize_text(F.col("text"), False))


def event_messages(events: DataFrame) -> DataFrame:
    """event_type is the conversation, user_id the speaker; times are cut to seconds."""
    epoch = F.unix_seconds(F.date_trunc("second", "ts"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return events.select(
        F.lit("wechat").alias("source"), F.col("event_type").alias("conv_uuid"), F.col("event_type").alias("conv_title"), F.col("event_id").cast("long").alias("pos"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("msg_id"), user.alias("sender"), user.alias("speaker_name"),
        F.concat(F.lit("value "), F.floor("value").cast("string")).alias("text"), epoch.alias("epoch"), iso_from_epoch(epoch).alias("ts"), kind_of(F.floor("value").cast("long") % 100).alias("kind"),
    )


def document_segments(docs: DataFrame) -> DataFrame:
    """Documents as segments of one text each."""
    none = F.lit("")
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("turn_id"), F.lit("documents").alias("source"), F.col("source").alias("source_id"),
        F.col("source").alias("conv_uuid"), F.col("source").alias("conv_title"), none.alias("ts"), F.lit(0).alias("ordinal"), none.alias("human_text"), none.alias("assistant_text"),
        F.coalesce("text", none).alias("full_text"),
    )
