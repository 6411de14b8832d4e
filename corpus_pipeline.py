"""The corpus pipeline: documents go through STAGES one after another.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, nearcopies, packing, quality, toxicity
from threadloom.llm.common import fold, materialize, table

#: Iterative training, components and packing can't be expressed in SQL.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models find toxic go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.keep(docs.select(*COLUMNS), model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality.keep(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word-shingle similarity of 0.8 or more) the document of the least id stays; of rows that repeat this id, one."""
    return nearcopies.keep_one(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
