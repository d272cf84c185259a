"""Vector recall: exact, batched, quantised."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .filters import current


def recall(memories: DataFrame, query: list[float], k: int, condition: Column | None = None, score=V.cosine) -> DataFrame:
    """The k best current memories: slot_id, score; ties by slot."""
    rows = memories.where(current() if condition is None else current() & condition)
    q = F.array(*(F.lit(float(x)) for x in query))
    v = V.doubles(F.col("vector"))
    checked = F.when(F.size("vector") == len(query), score(v, q)).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))
    return rows.select("slot_id", checked.alias("score")).orderBy(F.desc("score"), "slot_id").limit(k)


def recall_batch(memories: DataFrame, queries: DataFrame, k: int, block: int = 2_048, metric: str = "cosine", cells=None) -> DataFrame:
    """query_id, slot_id, score, rank: the k best current memories of each query (query_id, vector).

    The queries are collected and sent in blocks of at most ``block``; each task keeps k rows a
    query by one matrix product, and a window over those merges the tasks. ``metric``: cosine or dot.
    ``cells``: which cells (column ``cell`` of the memories) a query looks into, as a function of its vector.
    """
    import numpy as np

    rows = memories.where(current()).select("slot_id", F.col("vector").cast("array<double>").alias("vector"), *([F.col("cell").cast("int")] if cells else []))
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) if metric == "cosine" else x
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).orderBy("query_id").collect()
    out = None
    for at in range(0, max(len(asked), 1), block):
        part = asked[at : at + block]
        q = np.array([r.vector for r in part], float).reshape(len(part), -1)
        probed = np.array([np.isin(np.arange(cells.n), cells(r.vector)) for r in part]) if cells else None
        held = memories.sparkSession.sparkContext.broadcast(([r.query_id for r in part], unit(q) if len(part) else q, probed))

        def best(batches, held=held):
            import pyarrow as pa

            ids, q, probed = held.value
            if not ids:
                return
            for b in batches:
                slots = b.column("slot_id").to_numpy()
                if not len(slots):
                    continue
                m = b.column("vector").flatten().to_numpy().reshape(len(slots), -1)
                s = q @ unit(m).T
                if probed is not None:
                    s = np.where(probed[:, b.column("cell").to_numpy()], s, -np.inf)
                keep = np.lexsort((np.broadcast_to(slots, s.shape), -s), axis=1)[:, :k]
                width = keep.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(slots[keep].ravel()), pa.array(np.take_along_axis(s, keep, 1).ravel())], names=["query_id", "slot_id", "score"])

        found = rows.mapInArrow(best, "query_id long, slot_id long, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id"))
    if cells:
        out = out.where(F.col("score") > float("-inf"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


class ProductQuantizer:
    """Codebooks by k-means on a bounded sample; codes, distances and drift on all rows.

    Without ``subspaces`` there are 128 where the dimension allows, else as many as its largest divisor up to that.
    """

    def __init__(self, subspaces: int | None = None, cells: int = 256, seed: int = 7, max_rows: int = 20_000, rounds: int = 25):
        self.subspaces, self.cells, self.seed, self.max_rows, self.rounds, self.book = subspaces, cells, seed, max_rows, rounds, None

    def train(self, memories: DataFrame) -> ProductQuantizer:
        import numpy as np

        rows = memories.where(~F.col("tombstoned")).orderBy(F.xxhash64("slot_id"), "slot_id").limit(self.max_rows).select("slot_id", "vector").collect()
        x = np.array([r.vector for r in rows], float)
        if not len(x):
            raise ValueError("nothing to train on")
        rng = np.random.default_rng(self.seed)
        book = []
        self.subspaces = self.subspaces or max(m for m in range(1, 129) if x.shape[1] % m == 0)
        for p in np.split(x, self.subspaces, axis=1):
            if len(p) <= self.cells:
                book.append(p[np.arange(self.cells) % len(p)])
                continue
            c = [p[rng.integers(len(p))]]
            d = ((p - c[0]) ** 2).sum(1)
            for _ in range(self.cells - 1):
                c.append(p[rng.choice(len(p), p=d / d.sum()) if d.sum() else 0])
                d = np.minimum(d, ((p - c[-1]) ** 2).sum(1))
            c = np.array(c)
            for _ in range(self.rounds):
                d = (p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)[None]
                own = d.argmin(1)
                new = np.array([p[own == i].mean(0) if (own == i).any() else p[d.min(1).argmax()] for i in range(self.cells)])
                if np.allclose(new, c):
                    break
                c = new
            book.append(c)
        self.book = np.array(book)
        return self

    def _need(self):
        if self.book is None:
            raise ValueError("the quantizer is not trained")
        return self.book.tolist()

    def encode(self, vector: Column) -> Column:
        """The nearest cell of each subspace, the first at ties."""
        book = self._need()
        width = len(book[0][0])
        parts = []
        for m, cells in enumerate(book):
            v = F.slice(vector, m * width + 1, width)
            d = F.array(*(V.l2_sq(v, F.array(*map(F.lit, c))) for c in cells))
            parts.append((F.array_position(d, F.array_min(d)) - 1).cast("smallint"))
        return F.array(*parts)

    def encode_rows(self, memories: DataFrame) -> DataFrame:
        """slot_id, code, aligned (cosine of the vector and its decoded code)."""
        import numpy as np

        self._need()
        held = memories.sparkSession.sparkContext.broadcast(self.book)

        def run(batches):
            import pyarrow as pa

            book = held.value
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x = b.column("vector").flatten().to_numpy().reshape(n, -1)
                parts = x.reshape(n, len(book), -1)
                code = np.stack([((parts[:, m, None] - book[m][None]) ** 2).sum(2).argmin(1) for m in range(len(book))], 1)
                y = np.stack([book[m][code[:, m]] for m in range(len(book))], 1).reshape(n, -1)
                d = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("slot_id"), pa.array(code.astype(np.int16).tolist(), pa.list_(pa.int16())), pa.array(np.where(d == 0, 0, (x * y).sum(1) / np.where(d == 0, 1, d)))], names=["slot_id", "code", "aligned"])

        return memories.where(~F.col("tombstoned")).select("slot_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "slot_id long, code array<smallint>, aligned double")

    def decode(self, code: Column) -> Column:
        book = F.array(*(F.array(*(F.array(*map(F.lit, c)) for c in cells)) for cells in self._need()))
        return F.flatten(F.transform(code, lambda c, m: F.get(F.get(book, m), c.cast("int"))))

    def recall(self, memories: DataFrame, query: list[float], k: int, codes: DataFrame | None = None) -> DataFrame:
        """``codes``: encode_rows() of the memories, if it was written. Table distances keep max(8k, 128) coded memories, exact cosine the k best of them."""
        import numpy as np

        book = np.array(self._need())
        parts = np.array(query, float).reshape(len(book), 1, -1)
        table = ((parts - book) ** 2).sum(2)
        t = F.array(*(F.array(*map(F.lit, row.tolist())) for row in table))
        codes = self.encode_rows(memories) if codes is None else codes
        adc = F.aggregate(F.transform("code", lambda c, m: F.get(F.get(t, m), c.cast("int"))), F.lit(0.0), lambda s, x: s + x)
        near = codes.join(memories.where(current()).select("slot_id"), "slot_id", "left_semi").select("slot_id", adc.alias("d")).orderBy("d", "slot_id").limit(max(8 * k, 128))
        return recall(memories.join(F.broadcast(near.select("slot_id")), "slot_id", "left_semi"), query, k)

    def recall_batch(self, memories: DataFrame, queries: DataFrame, k: int, codes: DataFrame | None = None) -> DataFrame:
        """query_id, slot_id, score, rank: recall() for each query (query_id, vector); the queries are collected."""
        import numpy as np

        book = np.array(self._need())
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        own = asked.orderBy("query_id").collect()
        table = [((np.array(r.vector, float).reshape(len(book), 1, -1) - book) ** 2).sum(2) for r in own]
        cap = max(8 * k, 128)
        held = memories.sparkSession.sparkContext.broadcast(([r.query_id for r in own], table))

        def best(batches):
            import pyarrow as pa

            ids, table = held.value
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                slots, code = b.column("slot_id").to_numpy(), b.column("code").flatten().to_numpy().reshape(n, -1)
                for q, t in zip(ids, table):
                    d = t[np.arange(len(t)), code].sum(1)
                    keep = np.lexsort((slots, d))[:cap]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(keep), pa.int64()), pa.array(slots[keep]), pa.array(d[keep])], names=["query_id", "slot_id", "d"])

        now = memories.where(current())
        coded = self.encode_rows(now) if codes is None else codes.join(now.select("slot_id"), "slot_id", "left_semi")
        found = coded.mapInArrow(best, "query_id long, slot_id long, d double")
        rank = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
        near = found.withColumn("at", rank("d", "slot_id")).where(F.col("at") <= cap).select("query_id", "slot_id")
        pairs = near.join(F.broadcast(asked.withColumnRenamed("vector", "asked")), "query_id").join(now.select("slot_id", "vector"), "slot_id")
        scored = pairs.select("query_id", "slot_id", V.cosine(V.doubles(F.col("vector")), F.col("asked")).alias("score"))
        return scored.withColumn("rank", rank(F.desc("score"), "slot_id")).where(F.col("rank") <= k)

    def drifted(self, memories: DataFrame, least: float = 0.85) -> DataFrame:
        return self.encode_rows(memories).agg(F.coalesce(F.avg("aligned"), F.lit(1.0)).alias("alignment")).withColumn("drifted", F.col("alignment") < least)


def int8_recall(memories: DataFrame, query: list[float], k: int) -> DataFrame:
    """slot_id, score: the k best integer dot products of 8-bit vectors."""
    q = [max(-127, min(127, int(abs(x) * 127 + 0.5) * (1 if x >= 0 else -1))) for x in query]
    v = V.int8(V.doubles(F.col("vector")))
    s = F.aggregate(F.zip_with(v, F.array(*map(F.lit, q)), lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return memories.where(current()).select("slot_id", s.alias("score")).orderBy(F.desc("score"), "slot_id").limit(k)


def int8_recall_batch(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, slot_id, score, rank: int8_recall() for each query (query_id, vector), exact in whole numbers."""
    code = lambda c: V.int8(V.doubles(F.col(c))).cast("array<double>")
    return recall_batch(memories.withColumn("vector", code("vector")), queries.withColumn("vector", code("vector")), k, metric="dot")


def overlap_report(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """overlap (0 to 1), queries, top1 (their mean agreement on the first) of two recalls (query_id, slot_id, rank), by overlap."""
    mine, other = (x.groupBy("query_id").agg(F.collect_set("slot_id").alias(n), F.min_by("slot_id", "rank").alias(n + "1")) for x, n in ((a, "a"), (b, "b")))
    both = mine.join(other, "query_id").select(F.round(F.size(F.array_intersect("a", "b")) / k, 4).alias("overlap"), (F.col("a1") == F.col("b1")).cast("double").alias("same"))
    return both.groupBy("overlap").agg(F.count("*").alias("queries"), F.round(F.avg("same"), 6).alias("top1"))
