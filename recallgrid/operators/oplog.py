"""The write log, folded into current state."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(ops: DataFrame) -> DataFrame:
    """slot_id, text, tombstoned, n_ops: the last text written, and whether the slot was ever deleted."""
    return ops.groupBy("slot_id").agg(
        F.max_by("text", F.when(F.col("op") != "delete", F.col("op_seq"))).alias("text"), F.bool_or(F.col("op") == "delete").alias("tombstoned"), F.count("*").alias("n_ops"), F.max("op_seq").alias("last_seq")
    )


def compacted(state: DataFrame) -> DataFrame:
    """kept rows and bytes, and the bytes that tombstoned rows give back."""
    size = F.octet_length("text")
    return state.agg(F.count_if(~F.col("tombstoned")).alias("kept"), F.coalesce(F.sum(F.when(~F.col("tombstoned"), size)), F.lit(0)).alias("kept_bytes"), F.coalesce(F.sum(F.when(F.col("tombstoned"), size)), F.lit(0)).alias("reclaimed"))


def inserted(rows: DataFrame, dim: int, now_ns: int) -> DataFrame:
    """Rows of a slot's full shape from calls (text, vector, and any of layer, created_at_ns, valid_from_ns, entity_bitmap).

    A vector of another dimension raises; created_at is ``now_ns``, the layer 0 and valid_from 0 where not given.
    """
    given = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit("dimension mismatch")).cast(rows.schema["vector"].dataType))
    keep = [c for c in rows.columns if c not in ("vector", "layer", "created_at_ns", "valid_from_ns", "entity_bitmap")]
    return rows.select(
        *keep, checked.alias("vector"), given("layer", 0).cast("int").alias("layer"), given("created_at_ns", now_ns).cast("long").alias("created_at_ns"), given("valid_from_ns", 0).cast("long").alias("valid_from_ns"),
        given("entity_bitmap", 0).cast("long").alias("entity_bitmap"), F.lit(False).alias("tombstoned"), F.lit(False).alias("superseded"),
    )


def edges_added(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges (src, dst, edge_type, weight, seq) with new ones (src, dst, edge_type, weight, op_seq) appended to each source's in their order."""
    w = Window.partitionBy("src").orderBy("op_seq")
    at = edges.groupBy("src").agg(F.max("seq").alias("top"))
    more = new.withColumn("n", F.row_number().over(w)).join(at, "src", "left")
    return edges.unionByName(more.select("src", "dst", "edge_type", "weight", (F.coalesce("top", F.lit(-1)) + F.col("n")).cast(edges.schema["seq"].dataType).alias("seq")))


def edges_set(ops: DataFrame, inline: int = 4) -> DataFrame:
    """src, i, dst, edge_type, weight: the last write of each source's inline edge i below ``inline``; other places raise."""
    ok = F.when(F.col("i").between(0, inline - 1), F.col("i")).otherwise(F.raise_error(F.lit("no such inline edge")).cast("int"))
    last = ops.withColumn("i", ok).groupBy("src", "i").agg(F.max_by(F.struct("dst", "edge_type", "weight"), "op_seq").alias("e"))
    return last.select("src", "i", "e.*")


def backend(ops: DataFrame) -> DataFrame:
    """loadAll of a record store after its calls: id, slot_id, rec.

    ``ops``: op_seq, op (insert, update, remove), id, rec (JSON). An insert or update writes a new slot (its op_seq);
    an update also buries the id's slot before it, a remove the id's current one. An insert of a known id leaves the
    older slot in place, as the store does.
    """
    w = Window.partitionBy("id").orderBy("op_seq")
    rows = ops.withColumn("then", F.lead("op").over(w)).where("op in ('insert', 'update')")
    alive = rows.where(~F.coalesce(F.col("then").isin("update", "remove"), F.lit(False)))
    return alive.where(F.get_json_object("rec", "$.id").isNotNull()).select("id", F.col("op_seq").alias("slot_id"), "rec")


def page(rows: DataFrame, start: int, limit: int, done: int = 4294967295) -> DataFrame:
    """The next ``limit`` live rows from slot ``start`` in order, and next_slot, where to go on (``done``: nothing is left)."""
    from .filters import live

    alive = rows.where(live() & (F.col("slot_id") >= start))
    got = alive.orderBy("slot_id").limit(limit)
    last = got.agg(F.max("slot_id").alias("last"), F.count("*").alias("n"))  # one row
    top = rows.agg(F.max("slot_id").alias("top"))
    after = F.when((F.col("n") < limit) | (F.col("last") >= F.col("top")), F.lit(done).cast("long")).otherwise(F.col("last") + 1)
    return got.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(top)).withColumn("next_slot", after).drop("last", "n", "top")


def looked_up(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """slot_id, state ('live', 'tombstoned', 'no such slot'), text (null unless live) of the asked slots (slot_id)."""
    state = F.when(F.col("tombstoned").isNull(), "no such slot").when(F.col("tombstoned"), "tombstoned").otherwise("live")
    found = slots.join(rows.select("slot_id", "tombstoned", "text"), "slot_id", "left").withColumn("state", state)
    return found.select("slot_id", "state", F.when(F.col("state") == "live", F.col("text")).alias("text"))


def got(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """slot_id, text of the asked slots; a dead or unknown one raises."""
    text = F.when(F.col("state") == "live", F.col("text")).otherwise(F.raise_error(F.concat_ws(" ", "state", F.col("slot_id").cast("string"))).cast("string"))
    return looked_up(rows, slots).select("slot_id", text.alias("text"))


def found_by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, slot_id (-1: none) of records by their JSON id: the least live slot, one that isn't superseded first."""
    from .filters import live
    from .structured import record

    held = rows.where(live()).select(record(F.col("text"))["id"].alias("id"), "slot_id", "superseded").where("id is not null")
    best = held.groupBy("id").agg(F.min(F.struct("superseded", "slot_id")).alias("s"))
    return ids.join(best, "id", "left").select("id", F.coalesce("s.slot_id", F.lit(-1)).alias("slot_id"))
