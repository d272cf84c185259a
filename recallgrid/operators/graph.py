"""Typed traversal and version chains."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """t, slot_id, depth: the least number of links (t, src, dst) from the start rows (t, slot_id), up to ``hops``.

    Each hop uses the state before once, so the plan grows by one join and one aggregation a hop; the
    aggregation leaves the rows partitioned as the next join needs them.
    """
    e = links.select(F.col("t").alias("et"), "src", "dst").distinct()
    state = start.select("t", "slot_id").distinct().withColumn("depth", F.lit(0))
    for d in range(hops):
        step = state.join(e, (F.col("slot_id") == F.col("src")) & (F.col("t") == F.col("et")) & (F.col("depth") == d), "left")
        both = F.array(F.struct("slot_id", "depth"), F.struct(F.col("dst").alias("slot_id"), F.lit(d + 1).alias("depth")))
        state = step.select("t", F.explode(both).alias("x")).select("t", "x.*").where("slot_id is not null").groupBy("t", "slot_id").agg(F.min("depth").alias("depth"))
    return state


def traverse(edges: DataFrame, memories: DataFrame, seeds: DataFrame, edge_type: int | None, hops: int) -> DataFrame:
    """slot_id, depth reached from seeds (slot_id) over one edge type, or over each type by itself (edge_type None).

    Seeds don't count, tombstoned targets are neither returned nor walked through.
    """
    alive = memories.where(~F.col("tombstoned")).select(F.col("slot_id").alias("dst"))
    e = (edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)).select(F.col("edge_type").alias("t"), "src", "dst").join(alive, "dst", "left_semi")
    # An edge type is a byte: at most 256 rows.
    types = e.select("t").distinct() if edge_type is None else seeds.sparkSession.range(1).select(F.lit(edge_type).alias("t"))
    found = spread(e, seeds.select("slot_id").crossJoin(F.broadcast(types)), hops)
    return found.where("depth > 0").groupBy("slot_id").agg(F.min("depth").alias("depth")).join(seeds.select("slot_id"), "slot_id", "left_anti")


def as_of(versions: DataFrame, at) -> DataFrame:
    """chain_id, slot_id of the newest version created at or before ``at``; -1 if there is none."""
    known = versions.groupBy("chain_id").agg(F.max(F.when(F.col("created_at_ns") <= at, F.struct("version", "slot_id"))).alias("v"))
    return known.select("chain_id", F.coalesce(F.col("v.slot_id"), F.lit(-1)).alias("slot_id"))
