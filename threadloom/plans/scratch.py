"""Space that all executors share, for what is computed once and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    It is only made up where the setting is missing and everything runs on one
    machine, as in tests; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_threadloom_scratch", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        sc._threadloom_scratch = found
    return found


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later steps
    don't recompute it, and a lost executor doesn't lose it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before
            return
