"""Versioned merge of incoming segments into stored ones: append, skip or supersede.

Sequentially: an incoming segment whose key and content an active row has is skipped;
otherwise it is added and retires the active row of its key and those active rows of its conversation with
which it shares a message. Where the segments coming in for a conversation share no message among each
other, the order doesn't matter beyond who comes first, and joins decide all at once; other
conversations are folded one by one over ids and hashes only, never texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

KEYS = ("source", "conv_uuid")
ACTIONS = "arrival long, action string, retired array<long>, retired_new array<long>"


def _fold(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    # active rows: reference, key, content, messages; a stored row's reference is its id, a new one's the negative arrival less one
    live = {int(r.id): (r.source_key, r.content_hash, set(r.msg_ids)) for r in old.itertuples()}
    out = []
    for r in new.sort_values("arrival").itertuples():
        ids = set(r.msg_ids)
        if any(k == r.source_key and h == r.content_hash for k, h, _ in live.values()):
            out.append((r.arrival, "skipped", [], []))
            continue
        stale = [i for i, (k, _, m) in live.items() if k == r.source_key or m & ids]
        for i in stale:
            del live[i]
        live[-int(r.arrival) - 1] = (r.source_key, r.content_hash, ids)
        out.append((r.arrival, "superseded" if stale else "appended", [i for i in stale if i >= 0], [-i - 1 for i in stale if i < 0]))
    return pd.DataFrame(out, columns=["arrival", "action", "retired", "retired_new"])


def decide(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """arrival, action, retired (ids of stored rows), retired_new (arrivals). incoming: arrival, source, conv_uuid, source_key, content_hash, msg_ids;
    stored: the active rows with id."""
    new = incoming.select("arrival", *KEYS, "source_key", "content_hash", "msg_ids")
    old = stored.select("id", *KEYS, "source_key", "content_hash", "msg_ids")
    each = new.select("arrival", *KEYS, F.explode(F.array_distinct("msg_ids")).alias("m"))
    shared = each.groupBy(*KEYS, "m").count().where("count > 1").select(*KEYS).distinct()
    apart, mixed = new.join(shared, list(KEYS), "left_anti"), new.join(shared, list(KEYS), "left_semi")
    same = apart.join(old.select("source", "source_key", "content_hash"), ["source", "source_key", "content_hash"], "left_semi").select("arrival", F.lit(True).alias("skip"))
    rest = apart.join(same, "arrival", "left_anti")
    had = old.select("id", *KEYS, F.explode(F.array_distinct("msg_ids")).alias("m"))
    hits = rest.select("arrival", *KEYS, F.explode(F.array_distinct("msg_ids")).alias("m")).join(had, [*KEYS, "m"]).groupBy("id").agg(F.min("arrival").alias("arrival"))
    owned = hits.groupBy("arrival").agg(F.collect_list("id").alias("retired"))
    none = F.array().cast("array<long>")
    joined = apart.select("arrival").join(same, "arrival", "left").join(owned, "arrival", "left")
    action = F.when(F.col("skip"), "skipped").when(F.col("retired").isNotNull(), "superseded").otherwise("appended")
    by_set = joined.select("arrival", action.alias("action"), F.coalesce("retired", none).alias("retired"), none.alias("retired_new"))
    folded = mixed.groupBy(*KEYS).cogroup(old.join(shared, list(KEYS), "left_semi").groupBy(*KEYS)).applyInPandas(_fold, ACTIONS)
    return by_set.unionByName(folded)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds name: 0, 1, 2 ... in the order of columns; rows are ranged and counted by partition, not gathered."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_least"))
    first = sizes.select("_p", "_least", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_first"))
    return dealt.join(F.broadcast(first), "_p").withColumn(name, F.col("_first") + F.col("_m") - F.col("_least")).drop("_p", "_m", "_least", "_first")


def upsert(stored: DataFrame, incoming: DataFrame, first_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the new table, the actions). stored: segments with id, active, superseded_by; incoming: segments with arrival.
    New rows are numbered from first_id, else from after the largest id."""
    incoming = materialize(incoming, "incoming")
    actions = materialize(decide(incoming, stored.where("active")), "actions")
    return apply(stored, incoming, actions, first_id), actions


def apply(stored: DataFrame, incoming: DataFrame, actions: DataFrame, first_id: int | None = None) -> DataFrame:
    """stored after the actions that decide() found for incoming."""
    base = stored.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("b")).first().b if first_id is None else first_id
    fresh = actions.where("action <> 'skipped'").select("arrival", "retired", "retired_new")
    fresh = materialize(numbered(fresh, "_n", "arrival").select("arrival", (F.col("_n") + base).cast("long").alias("id"), "retired", "retired_new"), "ids")
    ids = fresh.select("arrival", "id")
    retired = fresh.select(F.col("id").alias("_by"), "retired", "retired_new")
    old = retired.select(F.explode("retired").alias("id"), "_by")
    within = retired.select(F.explode("retired_new").alias("arrival"), "_by").join(ids, "arrival").select("id", "_by")
    gone = old.unionByName(within)
    added = incoming.join(ids, "arrival").drop("arrival").withColumn("active", F.lit(True)).withColumn("superseded_by", F.lit(None).cast("long"))
    rows = stored.unionByName(added, allowMissingColumns=True).join(gone, "id", "left")
    return rows.withColumn("active", F.col("active") & F.col("_by").isNull()).withColumn("superseded_by", F.coalesce("superseded_by", "_by")).drop("_by")


def action_counts(actions: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(F.count("*").alias("turns_seen"), n("appended"), n("skipped"), n("superseded"))


def status(segments: DataFrame) -> DataFrame:
    """One row of counts over all rows, retired ones included."""
    return segments.agg(
        F.count("*").alias("rows_total"),
        F.count_if("active").alias("active_turns"),
        F.count_if(~F.col("active")).alias("superseded_turns"),
        F.countDistinct("conv_uuid").alias("conversations"),
        F.countDistinct("source").alias("sources"),
    )


def lineage(segments: DataFrame) -> DataFrame:
    """Retired rows with what replaced them."""
    new = segments.select(F.col("id").alias("superseded_by"), F.col("turn_id").alias("new_turn_id"), F.col("content_hash").alias("new_hash"), F.col("active").alias("new_active"))
    return segments.where("superseded_by is not null").join(new, "superseded_by", "left")
