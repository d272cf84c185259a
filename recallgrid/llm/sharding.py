"""Contiguous, byte-balanced shards from global prefix sums.

Rows are range-partitioned by (text hash, doc_id), the hash being the first 60 bits of MD5, each partition accumulates its own running
byte sum, and the per-partition totals (one row per partition) give every partition its global
offset. Cuts lie at equal byte targets, so the shards are contiguous in that order and equal
texts are neighbours. A run of equal texts no larger than the fraction ``slack`` of a shard's target
moves as a whole; longer runs are cut like anything else, so one hot text can't fill a shard.

Edge cases: null and empty texts have size 8 and one group; an empty table gives an empty result;
repeated doc_ids are separate rows; extra columns are ignored.
"""
from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship

ROW_OVERHEAD = 8


def _running(batches):
    import numpy as np
    import pyarrow as pa

    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy()
        ends = total + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("h"), pa.array(np.full(n, part, "int32")), pa.array(ends - size), pa.array(np.arange(rows, rows + n, dtype="int64"))],
            names=["doc_id", "size", "text_crc32", "h", "part", "before", "rn"],
        )
        if n:
            total, rows = int(ends[-1]), rows + n


def assign_shards(docs: DataFrame, shards: int = 24, slack: tuple[int, int] = (1, 50)) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(parts, "h", "doc_id").sortWithinPartitions("h", "doc_id")
    schema = T.StructType([*base.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("rn", T.LongType())])
    local = materialize(ordered.mapInArrow(_running, schema), "shards")
    # One row for each range partition: its number is the shuffle's, whatever the input.
    totals = sorted(local.groupBy("part").agg(F.max(F.col("before") + F.col("size")), F.count("*")).collect())
    offsets, at, seen = [], 0, 0
    for part, size, rows in totals:
        offsets.append((part, at, seen))
        at, seen = at + size, seen + rows
    offset = spark.createDataFrame(offsets, "part int, at long, seen long")
    rows = local.join(F.broadcast(offset), "part").select("doc_id", "size", "text_crc32", "h", (F.col("before") + F.col("at")).alias("lo"), (F.col("rn") + F.col("seen")).alias("pos"))
    total = max(at, 1)
    # Whole numbers throughout: middles and targets are doubled and multiplied by the number of shards.
    small = F.col("run_size") * F.lit(shards * slack[1]) <= F.lit(slack[0] * total)
    runs = rows.groupBy("h").agg(F.min("lo").alias("run_lo"), F.sum("size").alias("run_size"), F.count("*").alias("n")).where((F.col("n") > 1) & small).drop("n")
    runs = materialize(runs, "runs")  # apart from the join, whose hot runs Spark can then split
    middle = F.coalesce(2 * F.col("run_lo") + F.col("run_size"), 2 * F.col("lo") + F.col("size"))
    placed = rows.join(runs, "h", "left").withColumn("middle", middle).withColumn("shard", F.least(F.expr(f"middle * {shards}L div {2 * total}L"), F.lit(shards - 1)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "pos"), "placed")
    # At most `shards` rows.
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
