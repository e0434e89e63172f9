"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours that are larger (large star) or not larger (small star) than a node
    are tied to the smallest label around it."""
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = seen.join(low, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the component's smallest node.

    Nodes are longs. Self-loops and repeated edges do no harm; no edges give no rows. Each round is
    written to the shared folder. Rounds grow with the logarithm of the longest path; edges never
    leave the executors.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == sign:
            break
        sign = mark
        now = settle(_stars(_stars(now, True), False))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
