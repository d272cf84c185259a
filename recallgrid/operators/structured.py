"""Structured records: JSON with a string id inside a memory's text, beside plain prose."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, title string, content string, tags array<string>, is_latest boolean, project string"


def record(text: Column) -> Column:
    """The record, or null for prose, malformed JSON and records without a string id."""
    r = F.from_json(text, SCHEMA)
    is_text = F.get_json_object(text, "$.id").isNotNull() & text.rlike(r'"id"\s*:\s*"')
    return F.when(text.startswith("{") & is_text & r["id"].isNotNull(), r)


def unwrap(memories: DataFrame) -> DataFrame:
    """slot_id, memory_id, display, tags, is_latest: a missing is_latest counts as latest, prose shows as it is."""
    r = F.col("r")
    title, content = F.nullif(r["title"], F.lit("")), F.nullif(r["content"], F.lit(""))
    shown = F.when(r.isNull(), F.col("text")).otherwise(F.coalesce(F.concat_ws("\n", title, content), F.lit("")))
    return memories.withColumn("r", record(F.col("text"))).select("slot_id", r["id"].alias("memory_id"), shown.alias("display"), F.coalesce(r["tags"], F.array().cast("array<string>")).alias("tags"), F.coalesce(r["is_latest"], F.lit(True)).alias("is_latest"))


def tagged(rows: DataFrame, any_of: list[str] = (), all_of: list[str] = ()) -> DataFrame:
    if any_of:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_of))))
    if all_of:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, all_of)), F.col("tags"))) == 0)
    return rows


def normalised_tags(tags: Column, most: int = 8) -> Column:
    """Trimmed, without empties and repeats, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")), 1, most)


def context_pack(items: DataFrame, budget: int) -> DataFrame:
    """pack_id, item_id, used: mandatory items must fit, optional ones are skipped when they don't.

    ``items``: pack_id, ordinal, item_id, size, mandatory. A fold in order: one group a pack.
    """

    def fold(pdf):
        used, kept = 0, []
        for r in pdf.sort_values(["ordinal", "item_id"]).itertuples():
            if used + r.size_ > budget:
                if r.mandatory:
                    raise ValueError(f"mandatory item {r.item_id} is over the budget")
                continue
            used += r.size_
            kept.append((r.pack_id, r.item_id, used))
        import pandas as pd

        return pd.DataFrame(kept, columns=["pack_id", "item_id", "used"])

    return items.withColumnRenamed("size", "size_").groupBy("pack_id").applyInPandas(fold, "pack_id long, item_id long, used long")
