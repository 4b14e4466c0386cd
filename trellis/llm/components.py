"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _to_least(pairs: DataFrame, hubs: bool = False) -> DataFrame:
    """pairs (u, v): adds m, the least of u and all its v. Where a u can have very many v, minima
    are written first: then both sides of the join are plain shuffles, whose skewed parts are split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least, "least") if hubs else least
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (id, component): each id on an edge with the smallest id
    that links reach from it. Nulls and loops are left out; repeated edges count once; no
    edges give no rows. Each round is two joins on the vertex, with map-side minima, and
    ends in a table in the shared folder; stars of any size are rows, never one group."""
    now = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        held, now = now, materialize(
            small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "edges"
        )
        discard(held)
        # Equal edge sets (size and two sums of hashes) are a fixed point: every vertex then hangs on its least one.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
