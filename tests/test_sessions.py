"""Digests of sessions are those of the whole sessions, and no session is gathered for them."""

from pyspark.sql import functions as F

from threadloom.catalogue import QUERIES
from threadloom.operators.assemble import session_digests, sessions


def test_digests_are_those_of_sessions(spark):
    rows = [("w", "c\x1f\"é", "T", 1, "m\x0b1", "a", "A", "one\ntwo", 10), ("w", "c\x1f\"é", "T", 2, "m2", "b", "B", "", 20), ("w", "c\x1f\"é", "T", 3, "m3", "a", "A", None, 20), ("w", "c\x1f\"é", "T", 4, "m4", "b", "B", "海", 21)]
    rows += [("w", "c\x1f\"é", "T", 5, "m5", "d", "D", "", 400), ("w", "c\x1f\"é", "T", 6, "m6", "d", "D", None, 401)]  # a session without words
    rows += [("w", "long", "L", i, f"m{i}", f"u{i * i % 7}", "U", f"text {i}", i // 3) for i in range(25_000)]  # of several Arrow batches
    rows += [("x", f"c{i % 40}", "X", i, f"m{i}", f"u{i % 3}", "U", "t" * (i % 4), i * 97 % 9000) for i in range(2000)]
    df = spark.createDataFrame(rows, "source string, conv_uuid string, conv_title string, pos long, msg_id string, sender string, speaker_name string, text string, epoch long")
    df = df.withColumn("ts", F.concat(F.lit("t"), F.col("epoch"))).withColumn("kind", F.when(F.col("pos") % 2 == 0, "rich").otherwise("file"))
    whole = sessions(df).withColumn("messages", F.size("msg_ids"))
    digests = session_digests(df)
    assert digests.count() > 40
    assert sorted(map(repr, digests.collect())) == sorted(map(repr, whole.select(*digests.columns).collect()))
    assert session_digests(df.limit(0)).count() == 0


def test_a_session_is_not_gathered(spark):
    plan = QUERIES["segments_sessionized"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
