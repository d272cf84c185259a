"""Connected components by alternating large and small stars, without gathering edges anywhere.

The least neighbours are written before they are joined with the edges again, so the join doesn't inherit
the aggregation's partitioning and Spark can split the edges of a hub.

Edge cases: no edges give no rows; repeated edges and edges in both directions count once; extra columns
are ignored; null nodes aren't allowed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long), u <> v. Returns (node, root): every node that isn't its component's least, and that least."""
    now, before = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "edges")
    raise RuntimeError("components did not settle")
