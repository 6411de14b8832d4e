"""Incremental loading: a stream of messages merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import turns
from ..plans.store import Store, bucket


def follow_messages(messages: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """messages: a streaming DataFrame of messages with conv_pos, of conversations in any number of pieces and in any order.

    Each batch's messages are kept below ``<store>/messages``, a folder for each batch (a repeated batch replaces its own) with the
    store's buckets, and the conversations that it adds to are formed anew from all their messages; a message that comes again
    replaces the earlier one. Segments that share messages with older ones retire these.
    """
    spark, kept = store.spark, f"{store.path}/messages"

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{kept}/batch={number}")
        written = spark.read.schema(batch.schema.add("batch", "long").add("bucket", "integer")).option("basePath", kept).parquet(kept).where(F.col("batch") <= number)
        new = written.where(F.col("batch") == number).select("source", "conv_uuid", "bucket").distinct()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as the store has
        all_ = written.where(F.col("bucket").isin(touched)).join(new, ["source", "conv_uuid", "bucket"], "left_semi")
        latest = Window.partitionBy("source", "conv_uuid", "msg_id").orderBy(F.desc("batch"), F.desc("pos"))
        own = all_.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "batch", "bucket")
        place = own.groupBy("source", "conv_uuid").agg(F.min("conv_pos").alias("conv_pos"))
        segments = turns(own).join(place, ["source", "conv_uuid"])
        store.upsert(segments.withColumn("arrival", F.col("conv_pos") * (1 << 32) + F.col("ordinal")).drop("conv_pos"))

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
