"""What the operators of this subpackage share: tables, scratch space, folds and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import drop_path, materialize, scratch_dir

__all__ = ["drop_path", "materialize", "scratch_dir"]

#: Texts handed to Python code at once, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo n. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about SLICE_BYTES; a null text holds none."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def by_node(links, others, columns: int):
    """A mapInArrow function that calls links with whole nodes. others: places of rows that aren't of the last row's node."""

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(columns)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            last = others(held)
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, class_chars: int) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, label) of at most per_class labelled documents of each class, and
    (positive, all) counts of usable labels.

    Those of the smallest hash of doc_id are taken, one row for each id. In this order a row is left out
    if with it the class's texts exceeded class_chars characters; a long text so costs only itself. Rows with a null id or label don't
    count; of several labels for an id the largest holds.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    r = own.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = own.where("label = 1").orderBy(*order).limit(per_class).unionByName(own.where("label = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows of two numbers: a bounded broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = materialize(texts, "sample")
    # two numbers for each of at most 2 * per_class rows
    fitting, used = [], [0, 0]
    for row in texts.orderBy(*order).select("doc_id", "label", F.length("text").alias("chars")).collect():
        if used[row.label] + row.chars <= class_chars:
            used[row.label] += row.chars
            fitting.append((row.doc_id,))
    sized = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id", "left_semi")
    return sized, (int(r.p or 0), int(r.n))
