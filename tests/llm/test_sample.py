"""The labelled sample and what is learnt where a class is missing from it."""

import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, quality, toxicity


def test_a_long_text_costs_only_itself(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 10 == 0 else 20)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample, totals = common.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 4000)
    assert totals == (30, 60)
    assert {r.doc_id for r in sample.collect()} == {i for i in range(60) if i % 10}


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_a_class_of_too_long_texts_does_not_decide(spark, module, label):
    docs = spark.createDataFrame([(i, "some words here " * (1000 if i % 4 else 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], f"doc_id long, {label} int")
    assert module.train(docs, labels, F.lit(True), class_chars=2000) == 0.25
