"""Words and vectors fused, tag recall, re-ranking, recall along edges, and cell-probing recall."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import graph, lexical, structured, vector


def lexical_lane(rows: DataFrame, query: str, wide: int) -> DataFrame:
    """slot_id, text, score: the ``wide`` best live rows (slot_id, text, is_latest), without outdated ones.

    Outdated rows count in the corpus statistics and take places among the ``wide``.
    """
    found = lexical.bm25(rows.select(F.col("slot_id").alias("id"), "text"), query, wide)
    return F.broadcast(found).join(rows.where("is_latest"), F.col("id") == F.col("slot_id")).select("slot_id", "text", "score")


def hybrid(rows: DataFrame, query: str, k: int, near: DataFrame | None = None) -> DataFrame:
    """text, score, mode of the k best texts.

    ``near``: slot_id, text, score of a vector recall; without it words alone decide.
    """
    words = lexical_lane(rows, query, max(16 * k, 128))
    if near is None:
        return words.orderBy(F.desc("score"), "slot_id").limit(k).select("text", "score", F.lit("lexical").alias("mode"))
    lanes = [lexical.ranked(lane, "text", F.desc("score"), "slot_id") for lane in (near, words)]
    return lexical.rrf(lanes).limit(k).select(F.col("key").alias("text"), "score", F.lit("hybrid").alias("mode"))


def recall_by_tags(records: DataFrame, query: str, k: int, any_of: list[str] = (), all_of: list[str] = ()) -> DataFrame:
    """slot_id, display, score: of the max(6k, 30) best current records the first k with the tags."""
    deep = max(6 * k, 30)
    shown = structured.unwrap(records)
    rows = records.select("slot_id", "text").join(shown.select("slot_id", "is_latest"), "slot_id")
    found = lexical_lane(rows, query, max(16 * deep, 128)).orderBy(F.desc("score"), "slot_id").limit(deep).select("slot_id", "score")
    tagged = structured.tagged(F.broadcast(found).join(shown, "slot_id"), any_of, all_of)
    return tagged.orderBy(F.desc("score"), "slot_id").limit(k).select("slot_id", "display", "tags", "score")


def rerank(hits: DataFrame, n: int, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """The n first of (slot_id, text, rank) by the scorer of their text; rows it gives null, or all without one, keep their order."""
    if scorer is None:
        return hits.orderBy("rank").limit(n)
    return hits.withColumn("rescored", scorer(F.col("text"))).orderBy(F.desc_nulls_last("rescored"), "rank").limit(n)


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """slot_id of the seeds and all within ``hops`` edges of any type, through any node."""
    any_type = F.lit(0).alias("t")
    return graph.spread(edges.select(any_type, "src", "dst"), seeds.select(any_type, "slot_id"), hops).select("slot_id")


def recall_with_hops(memories: DataFrame, edges: DataFrame, query: list[float], k: int, hops: int, condition: Column | None = None) -> DataFrame:
    """The k best current memories among the 2k nearest and what they reach; hops 0 is plain recall."""
    if hops == 0:
        return vector.recall(memories, query, k, condition)
    near = reach(edges, vector.recall(memories, query, 2 * k, condition), hops)
    return vector.recall(memories.join(near, "slot_id", "left_semi"), query, k, condition)


class CellIndex:
    """Cells by k-means on a bounded sample; every memory has a cell, a query looks into the nearest few.

    write() keeps the memories in a folder for each cell, so a probe reads those folders only. Vectors without
    clusters need many probes: on the test embeddings 12 of 16 cells (three quarters of the rows) hold 0.95 of the
    ten nearest, 9 hold 0.87.
    """

    def __init__(self, cells: int = 16, probes: int = 12):
        self.quantizer, self.probes, self.path, self.schema = vector.ProductQuantizer(subspaces=1, cells=cells), probes, None, None
        self.n = cells

    def fit(self, memories: DataFrame) -> CellIndex:
        self.quantizer.train(memories)
        return self

    def assign(self, memories: DataFrame) -> DataFrame:
        return self.quantizer.encode_rows(memories).select("slot_id", F.col("code")[0].cast("int").alias("cell"))

    def write(self, memories: DataFrame, path: str, spread: int = 8) -> CellIndex:
        rows = memories.join(self.assign(memories), "slot_id")
        rows.repartition("cell", F.pmod(F.xxhash64("slot_id"), F.lit(spread))).write.partitionBy("cell").parquet(path)
        self.path, self.schema = path, rows.schema
        return self

    def rows(self, memories: DataFrame) -> DataFrame:
        """The memories with their cells: as written, else assigned now."""
        return memories.join(self.assign(memories), "slot_id") if self.path is None else memories.sparkSession.read.schema(self.schema).parquet(self.path)

    def nearest(self, query: list[float]) -> list[int]:
        import numpy as np

        d = ((np.array(query, float) - self.quantizer.book[0]) ** 2).sum(1)
        return [int(c) for c in np.argsort(d, kind="stable")[: self.probes]]

    def recall(self, memories: DataFrame, query: list[float], k: int, condition: Column | None = None) -> DataFrame:
        """Exact cosine within the probed cells."""
        return vector.recall(self.rows(memories).where(F.col("cell").isin(self.nearest(query))), query, k, condition)

    def recall_batch(self, memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """recall() for each query (query_id, vector)."""
        probe = lambda v: self.nearest(v)
        probe.n = self.n
        return vector.recall_batch(self.rows(memories), queries, k, cells=probe)


def perturbed(memories: DataFrame, copies: int, size: float = 0.05) -> DataFrame:
    """slot_id, copy, vector: unit vectors with fixed noise, to fan a corpus out."""
    rows = memories.select("slot_id", F.col("vector").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    noise = lambda i: ((F.col("slot_id") * 31 + (i + 1) * 17 + F.col("copy") * 101) % 2001 - 1000) / 1000.0 * size
    return rows.withColumn("v", F.transform("v", lambda x, i: x + noise(i))).select("slot_id", "copy", V.normalise(F.col("v")).alias("vector"))


def word_vector(text: Column, dim: int = 64) -> Column:
    """word_buckets() as a vector of length one (zeros for a text without words)."""
    return V.normalise(word_buckets(text, dim).cast("array<double>"))


def why_code(found: DataFrame) -> DataFrame:
    """bucket, slots (in their order) of tagged hits (slot_id, tags, rank): decision, then refactor, then bug, fix or gotcha, else other."""
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    bucket = F.when(has("decision"), "decisions").when(has("refactor"), "refactors").when(has("bug", "fix", "gotcha"), "bugs").otherwise("other")
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "slot_id"))), lambda x: x["slot_id"])
    return found.groupBy(bucket.alias("bucket")).agg(order.alias("slots"))


def word_buckets(text: Column, dim: int = 64) -> Column:
    """How many words fall into each of ``dim`` buckets by 32-bit FNV-1a over code points."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    bucket = F.transform(words, lambda w: (F.aggregate(F.array_remove(F.split(w, ""), ""), F.lit(2166136261).cast("long"), step) % dim).cast("int"))
    return V.once(bucket, lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(found) - F.size(F.array_remove(found, b))))
