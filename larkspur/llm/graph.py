"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _toward_least(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """Links neighbours (large star: those above the node; small star: those below, and the node) to the least of them.

    The node that a third of all edges have meets its least neighbour by broadcast."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    near = join_hot(both, least, "u", "n", total)
    if larger:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it is connected with) for every node of edges(u, v) but the roots themselves.

    Goes on until nothing changes: the number of rounds grows with the logarithm of the nodes."""
    now, last = materialize(edges.filter("u <> v").distinct(), "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        now = materialize(_toward_least(_toward_least(now, True, mark[0]), False, mark[0]), "links")
