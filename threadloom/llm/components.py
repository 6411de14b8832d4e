"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Links each neighbour to the least one; minima are pre-aggregated, and the
    join on a hot centre can be split, so that no group of neighbours is gathered."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    found = near.join(least, "u")
    if large:
        out = found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node, component: the least node reachable, for every node that edges (u, v) link to another.

    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    edges = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = _state(edges)
    while state[0]:
        edges = materialize(_star(_star(edges, True), False), label)
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)
