"""Exact top-k search by Fagin's threshold algorithm.

Vectors are quantised to integers, dealt into blocks, and each block of queries meets each
block of candidates in one task. There, one list per dimension is sorted by that
component; a query reads all lists in step from the end that suits its component's sign,
scores each vector on first sight, and after each depth stops once the bound, the query's product with
the components read last, can't reach its kth score any more. The first block of candidates is searched
before all others, and what a query's kth score is there is where it begins in them.

How early the bound stops depends on the data: where a few dimensions carry most of a product, after a small part of the lists; for directions
spread evenly over many dimensions, as random ones are, hardly before every vector has been seen (``threshold_search``
tells how many it scored).

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do null vec_ids; a query
meets the candidates of its own length only, and every row but its own: of rows that share a vec_id each is a candidate, and each that is asked is a query
with ranks of its own; candidates of equal score and vec_id are alike; scores beyond a long
are cut to its range; no queries or no candidates give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
#: Rows of a block.
QUERIES, CANDIDATES = 4096, 8192
#: Places of each list that are read before the bound is first tested; then half as many again each time.
DEPTH = 16


def threshold_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, values: np.ndarray, own: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best of x for q, those below floor left out if others are known to reach it, and how many were scored.

    lists, values: places and components, sorted by component, a column for each dimension; own: which rows are the query itself.
    """
    n = len(x)
    use = np.flatnonzero(q)
    up = q[use] > 0
    seen = own.copy()
    places, scores, scored = np.zeros(0, np.int64), np.zeros(0, x.dtype), 0
    depth, step = 0, DEPTH
    while depth < n:
        stop = min(n, depth + step) if len(use) else n
        fresh = np.zeros(n, bool)
        fresh[lists[n - stop : n - depth, use[up]]] = True
        fresh[lists[depth:stop, use[~up]]] = True
        fresh = (fresh if len(use) else ~seen) & ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        scored += len(new)
        places, scores = np.concatenate((places, new)), np.concatenate((scores, x[new] @ q))
        if len(places) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[keep], scores[keep]
            keep = np.lexsort((ids[places], -scores))[:k]
            places, scores = places[keep], scores[keep]
        depth, step = stop, step * 3 // 2
        if not len(use) or depth == n or seen.all():
            break
        last = np.where(up, values[n - depth, use], values[depth - 1, use]) @ q[use]
        least = scores.min() if len(places) == k else None
        if floor is not None and (least is None or floor > least):
            least = floor
        if least is not None and least > last:  # an equal score of a smaller id would still win
            break
    if floor is not None:
        keep = scores >= floor
        places, scores = places[keep], scores[keep]
    keep = np.lexsort((ids[places], -scores))[:k]
    return places[keep], scores[keep], scored


def _block(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    asked = rows["asked"].to_numpy(bool)
    ids, row = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
    out = []
    if asked.any() and not asked.all():
        m = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
        top = float(np.abs(m.astype(float)).max(initial=0))
        # double products are exact up to 2**53
        m = m.astype(float) if top * top * max(1, m.shape[1]) < 2**53 else m.astype(object)
        x, cid, crow = m[~asked], ids[~asked], row[~asked]
        lists = np.argsort(x, axis=0, kind="stable")
        values = np.take_along_axis(x, lists, axis=0)
        floors = [None if np.isnan(f) or m.dtype == object else f for f in rows["floor"][asked].astype(float)]
        for q, own, at, floor in zip(m[asked], ids[asked], row[asked], floors):
            places, scores, _ = threshold_search(q, x, cid, lists, values, crow == at, k, floor)
            out.append(pd.DataFrame({"query": at, "query_id": own, "vec_id": cid[places], "score": np.array([_long(s) for s in scores], np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})


def _long(score) -> int:
    return min(max(int(score), -(2**63)), 2**63 - 1)


def top_k(vectors: DataFrame, asked: str, k: int = K, scale: int = 64, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; asked: SQL condition on vec_id for the queries."""
    good = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    own = vectors.where(good).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.expr(f"transform(embedding, x -> floor({scale} * cast(x as double)))").alias("v"),
        F.expr(asked).alias("asked"),
        F.expr("size(embedding)").alias("dims"),
    )
    # written, so that a row has the same number wherever it is read
    own = materialize(own, "vectors")
    # a hash of the row deals them out evenly, whatever ids, vectors or lengths are common
    n = own.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    blocks, parts = -(-max(1, n.n) // candidates), -(-max(1, n.q) // queries)
    x = own.select("row", "vec_id", "v", "dims", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(False).alias("asked"), F.lit(None).cast("long").alias("floor"))
    q = own.where("asked").select("row", "vec_id", "v", "dims", F.pmod(F.xxhash64(F.lit("part"), "row"), F.lit(parts)).cast("int").alias("p"), F.lit(True).alias("asked"))

    def searched(candidates: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        each = asked.withColumn("b", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        return candidates.where(F.col("b").between(first, last)).unionByName(each).groupBy("b", "p", "dims").applyInPandas(lambda rows: _block(rows, k), "query long, query_id long, vec_id long, score long")

    found = searched(x, q.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if blocks > 1:
        found = materialize(found, "first-block")
        floors = found.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).withColumnRenamed("query", "row")
        found = found.unionByName(searched(x, q.join(floors, "row", "left"), 1, blocks - 1))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
