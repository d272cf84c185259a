"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint emits all variants within half the radius. Two fingerprints within the
radius share a variant, and any two that share one lie within the radius, so a variant's bucket is
a clique of at most 1 + 64 fingerprints (for radius 2): linking its least with each other one keeps
every component. Links are verified by the number of differing bits. Equal texts and equal
fingerprints are one node, so groups of copies never meet in one task.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; an empty
table gives an empty result; repeated rows share a component; extra columns are ignored.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize, ship, trimmed
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's UTF-8 bytes."""
    import numpy as np
    import xxhash

    words = raw.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(buf, seed)
    view, h64 = memoryview(buf), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size)
    begins = (ends - size)[: n - shingle + 1].tolist()
    ends = (ends - 1)[shingle - 1 :].tolist()
    h = np.array([h64(view[a:b], seed) for a, b in zip(begins, ends)], dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in b.column("body").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).mapInArrow(trimmed(run), "doc_id long, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that join all distinct fingerprints ``fp`` at most ``radius`` bits apart. An even radius only."""
    if radius not in (2, 4):
        raise ValueError("the radius must be 2 or 4: half of it is the ball that each fingerprint emits")
    masks = [0] + [sum(1 << b for b in c) for r in range(1, radius // 2 + 1) for c in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    flips = F.lit(signed).cast("array<long>") if len(signed) <= 65 else F.array(*map(F.lit, signed))
    # The variants leave from as many tasks as there are partitions, and are shuffled once.
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = F.first("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(least.alias("u"), F.col("fp").alias("v")).where("u <> v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the component's smallest doc_id) for every row."""
    rows = materialize(fingerprints(docs, shingle), "fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
