"""The write log as a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def maintain(ops: DataFrame, index_path: str, checkpoint: str):
    """Fold each batch of ops into rows of index_path; returns the running query's writer."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        folded = batch.groupBy("slot_id").agg(F.max_by("text", F.when(F.col("op") != "delete", F.col("op_seq"))).alias("text"), F.bool_or(F.col("op") == "delete").alias("tombstoned"), F.max("op_seq").alias("last_seq"))
        folded.write.mode("overwrite").parquet(f"{index_path}/batch={batch_id}")

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def lag(ops: DataFrame, index: DataFrame) -> DataFrame:
    """How far the index is behind the log."""
    return ops.agg(F.max("op_seq").alias("a")).crossJoin(index.agg(F.max("last_seq").alias("b"))).select((F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("lag"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def snapshot(spark: SparkSession, index_path: str) -> DataFrame:
    """The index as of its last finished batch: the newest row of each slot; it never waits for the running one."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(index_path)
    last = rows.groupBy("slot_id").agg(F.max_by(F.struct("text", "last_seq"), "last_seq").alias("r"), F.bool_or("tombstoned").alias("tombstoned"))
    return last.select("slot_id", "r.text", "tombstoned", "r.last_seq")


def states(events: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """entity, seq, state, legal for each event of a stream (entity, seq, state), kept by entity over batches.

    The first state of an entity is legal; a repeated or late sequence number is not. Rows of a batch are taken
    in the order of seq.
    """
    pairs = set(legal)

    def step(key, frames, state):
        import pandas as pd

        was = state.get if state.exists else None
        for f in frames:
            out = []
            for r in f.sort_values("seq").itertuples():
                ok = was is None or r.seq > was[0] and (was[1], r.state) in pairs
                out.append((key[0], r.seq, r.state, ok))
                if ok:
                    was = (int(r.seq), r.state)
            yield pd.DataFrame(out, columns=["entity", "seq", "state", "legal"])
        if was is not None:
            state.update(was)

    return events.groupBy("entity").applyInPandasWithState(step, "entity long, seq long, state string, legal boolean", "seq long, state string", "append", "NoTimeout")


def latest(events: DataFrame) -> DataFrame:
    """entity, state, seq: the newest state of each entity, updated with each batch."""
    return events.groupBy("entity").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def since(events: DataFrame, cursor: int, limit: int) -> tuple[DataFrame, int]:
    """The next ``limit`` events after a cursor in order, and the cursor to go on from."""
    got = events.where(F.col("seq") > cursor).orderBy("seq").limit(limit)
    return got, got.agg(F.coalesce(F.max("seq"), F.lit(cursor))).first()[0]
