"""BM25 over text columns, and rank fusion."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75


class Postings:
    """An inverted index as a table: (term, id, tf, dl) in buckets of terms, and one row of corpus statistics.

    A query reads the buckets of its terms and, of these, the row groups with the terms; texts are cut into tokens
    once, when the index is written. A bucket is written by several tasks, as a frequent term is in every text.
    """

    SCHEMA = "term string, id {id}, tf int, dl int, bucket int"

    def __init__(self, spark, path: str, id_type: str = "long", buckets: int = 64):
        self.spark, self.path, self.id_type, self.buckets = spark, path, id_type, buckets

    def write(self, docs: DataFrame, spread: int = 8) -> Postings:
        """Index (id, text); texts without tokens count in the statistics."""
        toks = docs.select("id", tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
        rows = toks.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        rows = rows.select("term", "id", "tf", "dl", F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int").alias("bucket"))
        rows = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("bucket", "term", "id")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        toks.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl")).coalesce(1).write.parquet(f"{self.path}/stats")
        return self

    def search(self, query: str, k: int) -> DataFrame:
        """As bm25()."""
        import re
        import zlib

        terms = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
        rows = self.spark.read.schema(self.SCHEMA.format(id=self.id_type)).parquet(f"{self.path}/postings")
        rows = rows.where(F.col("bucket").isin([zlib.crc32(t.encode()) % self.buckets for t in terms]) & F.col("term").isin(terms))
        stats = F.broadcast(self.spark.read.schema("n long, avgdl double").parquet(f"{self.path}/stats"))  # one row
        df = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the query
        f = F.col("tf")
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = rows.join(df, "term").crossJoin(stats).groupBy("id").agg(F.sum(part).alias("score"))
        return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def _same(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, query: str, k: int) -> DataFrame:
    """The k best (id, score) of (id, text): query terms count once, only positive scores, ties by id.

    One pass: a text's tokens are cut to the query's terms before anything is grouped.
    """
    import re

    terms = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    t = F.col("tokens")
    rows = docs.select("id", tokens(F.col("text")).alias("tokens")).select("id", F.size(t).alias("dl"), *(F.size(F.filter(t, _same(w))).alias(f"tf{i}") for i, w in enumerate(terms)))
    # One row: the corpus' size, mean length and document frequencies.
    stats = rows.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    # No filter on the counts here: pushed below the projection, it would cut every text into tokens again.
    hit = rows.crossJoin(F.broadcast(stats))
    score = sum((F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) for i in range(len(terms))), F.lit(0.0))
    return hit.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def rrf(lanes: list[DataFrame], k: int = 60) -> DataFrame:
    """key, score from ranked lanes (key, rn from 1): the sum of 1 / (k + rn); ties by first sight."""
    every = None
    for i, lane in enumerate(lanes):
        part = lane.select("key", "rn", F.lit(i).alias("lane"))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy("key").agg(F.sum(1.0 / (k + F.col("rn"))).alias("score"), F.min(F.struct("lane", "rn")).alias("first"))
    return out.orderBy(F.desc("score"), "first").select("key", "score")


def ranked(df: DataFrame, key: str, *order) -> DataFrame:
    """key, rn of a top-k result (bounded by its k)."""
    return df.select(F.col(key).alias("key"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rn"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.025) -> DataFrame:
    """query_id, slot_id, rank: greedy choice of score less weight times the greatest cosine to what is chosen.

    ``candidates``: query_id, slot_id, score, vector; a few dozen a query.
    """

    def pick(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "slot_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(pdf.vector.tolist(), float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
        most, left, out = np.zeros(len(x)), np.ones(len(x), bool), []
        while left.any() and len(out) < k:
            i = int(np.where(left, pdf.score.to_numpy() - weight * most, -np.inf).argmax())
            left[i] = False
            out.append(i)
            most = np.maximum(most, x @ x[i])
        got = pdf.loc[out, ["query_id", "slot_id"]].copy()
        got["rank"] = range(1, len(out) + 1)
        return got

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, slot_id long, rank int")
