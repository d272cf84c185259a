"""Hash-chained logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
_FIELDS = ["seq", "event", "slot_id", "at"]


def entry_hash(prev, *fields):
    """sha256 of the previous hash and the fields, joined by '|'."""
    return F.sha2(F.concat_ws("|", prev, *(F.col(f).cast("string") for f in fields)), 256)


def chained(log: DataFrame, owner: str, fields: list[str], names: tuple[str, str] = ("prev_hash", "hash")) -> DataFrame:
    """Adds each row's previous and own hash. ``fields`` begin with the sequence.

    A chain is sequential in its construction: an owner's rows stream through one task in their order, and
    only the last hash is held.
    """
    spark = log.sparkSession
    rows = log.select(F.col(owner).cast("string").alias(owner), *(F.col(f).cast("long" if i == 0 else "string").alias(f) for i, f in enumerate(fields)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        who, at = None, GENESIS
        for b in batches:
            before, own = [], []
            for key, *row in zip(b.column(owner).to_pylist(), *(b.column(f).to_pylist() for f in fields)):
                if (key,) != who:
                    who, at = (key,), GENESIS
                before.append(at)
                at = hashlib.sha256("|".join([at, *(str(x) for x in row if x is not None)]).encode()).hexdigest()
                own.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names, *names])

    schema = ", ".join([f"{owner} string", f"{fields[0]} long", *(f"{f} string" for f in fields[1:]), *(f"{x} string" for x in names)])
    return rows.repartition(n, owner).sortWithinPartitions(owner, fields[0]).mapInArrow(run, schema)


def build(log: DataFrame) -> DataFrame:
    """prev_hash and hash of an audit log (org_id, seq, event, slot_id, at)."""
    return chained(log, "org_id", _FIELDS).withColumn("slot_id", F.col("slot_id").cast("long"))


def verify(chain: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """org_id, entries, chain_valid, broken_at, checkpoint_seq, attested, since.

    Each row is checked by itself and against the one before; broken_at is the first that fails. The latest of
    ``checkpoints`` (org_id, seq, hash) attests the chain if its entry is there with its hash; since: entries
    after it. Orgs without a checkpoint have nulls.
    """
    w = Window.partitionBy("org_id").orderBy("seq")
    bad = (entry_hash(F.col("prev_hash"), *_FIELDS) != F.col("hash")) | (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    rows = chain.withColumn("bad", bad)
    if checkpoints is None:
        none = F.lit(None)
        out = rows.groupBy("org_id").agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"))
        return out.select("org_id", "entries", F.col("broken_at").isNull().alias("chain_valid"), "broken_at", none.cast("long").alias("checkpoint_seq"), none.cast("boolean").alias("attested"), none.cast("long").alias("since"))
    last = checkpoints.groupBy("org_id").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("c"))
    rows = rows.join(last, "org_id", "left")
    out = rows.groupBy("org_id").agg(
        F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"), F.first("c.seq").alias("checkpoint_seq"),
        F.max((F.col("seq") == F.col("c.seq")) & (F.col("hash") == F.col("c.hash"))).alias("attested"), F.count_if(F.col("seq") > F.col("c.seq")).alias("n"),
    )
    return out.select("org_id", "entries", F.col("broken_at").isNull().alias("chain_valid"), "broken_at", "checkpoint_seq", "attested", F.when(F.col("checkpoint_seq").isNotNull(), F.col("n")).alias("since"))


def illegal_steps(log: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """Rows of (entity, seq, state) whose step from the state before isn't among the legal (was, state)."""
    w = Window.partitionBy("entity").orderBy("seq")
    pairs = log.sparkSession.createDataFrame(legal, "was string, state string")
    return log.withColumn("was", F.lag("state").over(w)).where("was is not null").join(F.broadcast(pairs), ["was", "state"], "left_anti")
