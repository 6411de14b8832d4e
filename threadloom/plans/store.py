"""A versioned store of segments in Parquet, and the loading of sources into it."""

from __future__ import annotations

import json
import os
import sys
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.assemble import SEGMENT_COLUMNS
from ..sources.files import SourceAdapter, resolve_adapter
from .scratch import materialize

SCHEMA_VERSION = "2"
#: Files of a store: conversations are dealt out by a hash, and a load writes anew those of its own conversations only.
BUCKETS = 64
#: How often a load is merged anew if others commit meanwhile.
ATTEMPTS = 5
_SPAN = "array<struct<speaker_id:string,speaker_name:string,text:string>>"
_KINDS = {"msg_ids": "array<string>", "ordinal": "int", "speaker_spans": _SPAN, "participants": "array<string>", "media_refs": "array<string>"}
SCHEMA = "id long, " + ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in SEGMENT_COLUMNS) + ", active boolean, superseded_by long, indexed_at timestamp"


def default_index_path() -> Path:
    if own := os.environ.get("THREADLOOM_INDEX"):
        return Path(own).expanduser()
    home = Path.home()
    base = home / "Library/Application Support" if sys.platform == "darwin" else Path(os.environ.get("XDG_DATA_HOME", home / ".local/share"))
    return base / "threadloom" / "index"


@dataclass(frozen=True)
class IndexStats:
    conversations: int
    messages: int
    turns_seen: int
    appended: int
    skipped: int
    superseded: int


class Conflict(RuntimeError):
    """Another load committed meanwhile."""


@dataclass
class Manifest:
    """What a number stands for: the folder of each bucket, the next row's id, and the version of the rows' columns."""

    number: int = -1
    version: str = SCHEMA_VERSION
    next_id: int = 0
    parts: dict[str, str] = field(default_factory=dict)


def bucket(source: Column | str = "source", conv_uuid: Column | str = "conv_uuid") -> Column:
    return F.pmod(F.xxhash64(source, conv_uuid), F.lit(BUCKETS)).cast("int")


class Store:
    """Segments below one path of any file system Spark reads.

    Files are never changed. ``manifests`` holds a file for each number from 0, which exactly one load can create; the newest one that
    is whole is the current state, so that readers never write, a failed load leaves no trace, and of two loads
    that began with the same state the second merges anew. A load without changes commits nothing.
    """

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, str(path)

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        at, fs = self._fs("manifests")
        names = sorted((x.getPath().getName() for x in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for name in names:
            if not name.isdigit():
                continue
            stream = fs.open(self._fs("manifests", name)[0])
            try:
                found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # being written
                continue
            finally:
                stream.close()
            if int(found["version"]) > int(SCHEMA_VERSION):
                raise ValueError(f"the store has version {found['version']}, this library knows {SCHEMA_VERSION}")
            return Manifest(int(name), **found)
        return Manifest()

    def _publish(self, new: Manifest) -> None:
        name, at = f"{new.number:08d}", self._fs("manifests")
        at[1].mkdirs(at[0])
        text = json.dumps({"version": new.version, "next_id": new.next_id, "parts": new.parts})
        target, fs = self._fs("manifests", name)
        try:
            if fs.getScheme() == "file":  # whose create() isn't exclusive
                with open(Path(target.toUri().getPath()), "x", encoding="utf-8") as f:
                    f.write(text)
            else:
                stream = fs.create(target, False)
                stream.write(bytearray(text.encode()))
                stream.close()
        except FileExistsError as e:
            raise Conflict(name) from e
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(name) from e
            raise

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}/bucket={k}" for k, folder in m.parts.items() if buckets is None or int(k) in buckets]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        # columns that older rows lack are null, and these follow from others
        fill = {"source_id": "conv_uuid", "ts_start": "ts", "ts_end": "ts"}
        return self.spark.read.schema(SCHEMA).parquet(*folders).withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(other)) for c, other in fill.items()})

    def segments(self) -> DataFrame:
        return self._rows(self.manifest())

    def upsert(self, incoming: DataFrame) -> DataFrame:
        """Merges segments with arrival and returns the counts of actions."""
        incoming = materialize(incoming.withColumn("indexed_at", F.current_timestamp()), "incoming")
        for _ in range(ATTEMPTS):
            m = self.manifest()
            # at most BUCKETS numbers; no segment meets one of another bucket
            touched = [r.b for r in incoming.select(bucket().alias("b")).distinct().collect()]
            stored = self._rows(m, touched)
            actions = materialize(merge.decide(incoming, stored.where("active")), "actions")
            counts = merge.action_counts(actions).first()
            if counts.appended + counts.superseded or m.version != SCHEMA_VERSION:
                try:
                    self._commit(m, incoming, actions, counts.appended + counts.superseded)
                except Conflict:
                    continue
            return self.spark.createDataFrame([counts])
        raise Conflict(f"{ATTEMPTS} times in a row")

    def _commit(self, m: Manifest, incoming: DataFrame, actions: DataFrame, added: int) -> None:
        changed = [r.b for r in incoming.join(actions.where("action <> 'skipped'"), "arrival").select(bucket().alias("b")).distinct().collect()]
        # rows of an older version are all written anew with the columns that they lack
        own = changed if m.version == SCHEMA_VERSION else list(range(BUCKETS))
        new = incoming.where(bucket().isin(changed)) if changed else incoming.limit(0)
        rows = merge.apply(self._rows(m, own), new, actions, m.next_id)
        folder = f"load-{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", "active", "id").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        at, fs = self._fs(folder)
        written = [x.getPath().getName().split("=")[1] for x in fs.listStatus(at) if "=" in x.getPath().getName()]
        self._publish(Manifest(m.number + 1, SCHEMA_VERSION, m.next_id + added, m.parts | dict.fromkeys(written, folder)))

    def status(self) -> dict:
        m = self.manifest()
        return {"schema_version": m.version} | merge.status(self._rows(m)).first().asDict()


def index_source(spark: SparkSession, source: str | Path, index_path: str | Path, *, source_name: str | None = None, adapter: SourceAdapter | None = None) -> IndexStats:
    adapter = adapter or resolve_adapter(source, source_name)
    messages, segments = adapter.load(spark, source)
    # of an export, what others than the two sides said isn't counted
    said = (F.col("pos") >= 0) & ((F.col("source") != "claude") | F.col("sender").isin("human", "assistant"))
    r = messages.agg(F.count_if(F.col("pos") < 0).alias("c"), F.count_if(said).alias("m")).first()
    counts = Store(spark, index_path).upsert(segments).first()
    return IndexStats(r.c, r.m, counts.turns_seen, counts.appended, counts.skipped, counts.superseded)


def index_export(spark: SparkSession, source: str | Path, index_path: str | Path) -> IndexStats:
    return index_source(spark, source, index_path, source_name="claude")


def stats_dict(stats: IndexStats) -> dict:
    return asdict(stats)
