"""Every stage on odd rows and empty tables, and what the whole keeps of planted documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "which of the seven rivers runs past the old mill before it meets the northern sea"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, good=True):
    words = [f"word{int(x) % 900}" for x in rng.zipf(1.3, n)]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "$$$" for w in words)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic documents 0 to 119, bad ones to 239, then clean ones; copies, near copies, benchmark passages and odd rows after 10,000."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, int(rng.integers(30, 90)), not 120 <= i < 240).split()
        if i < 120:
            for _ in range(5):
                words.insert(int(rng.integers(len(words))), f"insult{int(rng.integers(2))}")
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not 120 <= i < 240), int(i < 120)))
    base = rows[300][1].split() + [f"tail{k}" for k in range(60)]
    rows[300] = (300, " ".join(base), "en", "s", 1)
    rows += [(10_000, rows[301][1], "en", "s", 1), (10_001, " ".join([*base[:50], "changed", *base[51:]]), "en", "s", 1), (10_002, rows[302][1] + " " + ITEM + ". " + rows[303][1], "en", "s", 1)]
    odd = [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "one"), (None, rows[310][1] + " of no id"), (None, None), (310, rows[310][1]), (310, prose(rng, 60)), (20_004, prose(rng, 120_000))]
    rows += [(i, t, None, None, None) for i, t in odd]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_what_is_kept(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / name))
        n, docs = docs.count(), spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS) and docs.count() <= n
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic, bad, clean = set(range(120)), set(range(120, 240)), set(range(240, 900))
    after = dict(zip(["begin", *(n for n, _ in pipeline.STAGES)], ids))
    assert len(after["toxicity"] & toxic) < 12 and len(clean - after["toxicity"]) < 14
    assert len(after["quality"] & bad) < 12 and len((after["toxicity"] - after["quality"]) & clean) < 14
    gone = after["quality"] - after["near_duplicates"]
    assert not {10_000, 10_001} & after["near_duplicates"] and not gone & clean
    assert after["near_duplicates"] - after["decontamination"] == {10_002} & after["near_duplicates"]
    assert after["packing"] == after["decontamination"]
    whole = spark.read.parquet(str(tmp_path / "packing"))
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert {tuple(r) for r in pipeline.run(spark, tables).select("doc_id", "piece", "ids_crc32").collect()} == {tuple(r) for r in whole.select("doc_id", "piece", "ids_crc32").collect()}


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_on_odd_rows_and_none(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id is null or doc_id >= 10000 or doc_id = 310")
    twice = docs.unionByName(docs).withColumns({"key": F.lit(1), "root": F.lit("x"), "_h": F.lit(2.0)})
    out = stage(spark, twice, tables)
    if name == "packing":  # a row for each piece
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in twice.select("doc_id").collect()}
    else:
        assert out.count() <= twice.count() and out.columns == list(pipeline.COLUMNS)
    assert stage(spark, docs.limit(0), tables).count() == 0
