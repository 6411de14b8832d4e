"""Token files: frequency-ranked ids, byte-aligned variable-length, with separate control bytes.

An id is written as its rank by frequency over all documents, in one to four bytes; a
control byte holds the lengths (less one) of four ids, two bits each, the first lowest.
Control bytes and data bytes of a chunk of documents are two columns of one row, so that
the file is written, committed and read by Spark wherever its file system is. Reading
looks each control byte up in a table of 256 x 4 lengths and adds up the bytes with numpy.

Rows of ``<path>/chunks``: shard (in doc_id order), chunk, first (ids before it in its shard),
doc_ids, lengths, control, data; ``<path>/ranks`` holds the ids by rank (never more rows than the vocabulary).

Defined results: a null or empty text is its end id alone; null doc_ids come first; equal doc_ids are all kept, in the order of
their texts' hashes, and may lie in several ranges; no documents give an empty file; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import drop_path, materialize, scratch_dir, shuffle_partitions, slices, text_column
from .tokens import encoder

END = 0
#: Ids of a chunk, unless one document has more.
CHUNK = 1 << 18
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_CHUNK = "shard int, chunk int, first long, doc_ids array<long>, lengths array<int>, control binary, data binary"


def _tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, h (a hash of the text), width (bytes of an id) and ids of every row of docs."""

    def run(batches):
        own, end = encoder(tokenizer), END.to_bytes(4, "little")
        width = 2 if own.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in own.encode_all(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(ids), width, np.int32)), pa.array(ids, pa.binary())], ["doc_id", "h", "width", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column()).alias("h"), text_column().alias("text"))
    return own.mapInArrow(run, "doc_id long, h long, width int, ids binary")


def _each(batch: pa.RecordBatch):
    """The ids of each row. batch: width and ids last."""
    for width, x in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
        yield np.frombuffer(x.as_py(), f"<u{width}")


def _counts(ids: DataFrame) -> DataFrame:
    def run(batches):
        total, held, size = np.zeros(0, np.int64), [], 0

        def added():
            c = np.bincount(np.concatenate(held)) if held else np.zeros(0, np.int64)
            n = max(len(c), len(total))
            return np.pad(total, (0, n - len(total))) + np.pad(c, (0, n - len(c)))

        for batch in batches:
            for x in _each(batch):
                held.append(x)
                size += len(x)
                if size >= CHUNK:  # many documents at once, as the vocabulary is larger than most of them
                    total, held, size = added(), [], 0
        total = added()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return ids.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the token file of docs (doc_id, text) at path. Texts are never shuffled, only their ids."""
    spark = docs.sparkSession
    raw = f"{path}/ids"
    _tokenised(docs, tokenizer).write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema("doc_id long, h long, width int, ids binary").parquet(raw)
    ranked = [r.id for r in _counts(ids).orderBy(F.desc("n"), "id").collect()]  # as many as the vocabulary has, at most
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    table = spark.sparkContext.broadcast(rank_of)

    def chunks(batches):
        shard = TaskContext.get().partitionId()
        chunk = first = total = 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            n = [len(x) for _, x in held]
            control, data = pack(table.value[np.concatenate([x for _, x in held])])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            row = [shard, chunk, first, [d for d, _ in held], n, control, data]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), _each(batch)):
                held.append((d, x))
                total += len(x)
                if total >= CHUNK:
                    yield flush()
                    chunk, first, total = chunk + 1, first + total, 0
                    held.clear()
        if held:
            yield flush()

    # rows of one id and text have the same ids, so that a number of each row may part them
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    numbered = ids.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    dealt.mapInArrow(chunks, _CHUNK).write.option("compression", "zstd").parquet(f"{path}/chunks")
    drop_path(spark, raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), n_tokens, ids_crc32 of each document of a token file."""
    ranked = np.array([r.id for r in spark.read.schema("rank int, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    table = spark.sparkContext.broadcast(ranked)
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                lengths = one.column(4).to_pylist()[0]
                n = np.array(lengths, np.int64)
                ids = table.value[unpack(one.column(5)[0].as_py(), one.column(6)[0].as_py(), int(n.sum()))].astype("<u4") if n.sum() else np.zeros(0, "<u4")
                ends = np.cumsum(n)
                parts = [ids[e - s : e].tobytes() for s, e in zip(n, ends)]
                before = one.column(2)[0].as_py() + ends - n
                shard = pa.array(np.full(len(n), one.column(0)[0].as_py(), np.int32))
                doc = pa.array(one.column(3).to_pylist()[0], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, shard, pa.array(before), pa.array(parts, pa.binary()), pa.array(n), pa.array([zlib.crc32(x) for x in parts], pa.int64())], ["doc_id", "shard", "before", "ids", "n_tokens", "ids_crc32"])

    # a row for each shard, thus for each partition that was written
    sizes = chunks.groupBy("shard").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    offsets = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("offset"))
    rows = chunks.mapInArrow(run, "doc_id long, shard int, before long, ids binary, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "ids", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a token file in the shared folder and returns what reading it gives, without the ids; the file is removed."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    found = materialize(read(spark, path).drop("ids"), "round-trip")
    drop_path(spark, path)
    return found
