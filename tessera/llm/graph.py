"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an
    edge.  Alternates large-star and small-star steps: each links a node's
    neighbours to the smallest of them, found by an aggregate with map-side
    combine and joined back, so a hub's edges are never gathered in one task.
    Every round is written to the shared folder; the rounds end when the set of
    edges no longer changes.  Self loops and repeated edges are allowed."""
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    e = saved(e, "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = saved(e, "components")
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
