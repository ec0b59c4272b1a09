"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the node's least neighbour: the larger neighbours, or the smaller and the node."""
    if large:
        near = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
    joined = near.join(least, F.col("u") == F.col("__u")).withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("__u"), F.col("m")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) with an edge: root is the least node of its component.

    Alternates large and small stars until nothing changes, a logarithmic number of rounds in practice; each
    round is written to the shared folder. A hub of any degree is only ever a join key and a partial minimum.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        now = saved(_star(_star(now, True), False), "stars")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = sign
