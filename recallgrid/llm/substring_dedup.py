"""Substring deduplication by a log-structured index of window hashes.

Every window of ``window`` words selects one anchor: the minimum hash of its ``gram``-word grams, the
rightmost at ties. Equal windows select equal anchors at the same offset, so anchors (about one for
each 20 words) find every repeated window. The index is a list of immutable runs, each sorted by
anchor hash. A batch is merge-joined with the runs of earlier batches and with itself; anchors that
two different texts hold are verified: for these the 128-bit digest of every window that selects
the anchor is compared, and each digest keeps its smallest doc_id. Then the batch becomes a run, and
when ``max_runs`` are there they are merged into one, still sorted.

Documents whose whole word sequence has come before are settled by one digest and add no anchors,
so large groups of copies cost one row each. Nothing is collected, and no pairs are made.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; equal
texts keep the smallest doc_id's; rows with one doc_id are one document's only if equal in text
(doc_id must be a key); an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, materialize, shared_dir, ship, trimmed

WINDOW, GRAM = 50, 12
_ANCHORS = "doc_id long, seq_a long, seq_b long, n_words long, anchors array<struct<hash:long,pos:int,lo:int,hi:int>>"


def _digest(raw: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def anchors_of(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Arrays (hash, pos, lo, hi): windows that start at lo..hi select the gram at pos."""
    import numpy as np
    import xxhash

    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - gram + 1
    g = h[:m].copy()
    for i in range(1, gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(31)
        g += h[i : i + m]
    g ^= g >> np.uint64(33)
    g *= np.uint64(0xFF51AFD7ED558CCD)
    g ^= g >> np.uint64(33)
    span = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    pos = np.arange(len(view)) + span - 1 - np.argmin(view[:, ::-1], axis=1)
    first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
    last = np.append(first[1:], len(pos)) - 1
    at = pos[first]
    return g[at].view(np.int64), at.astype(np.int32), first.astype(np.int32), last.astype(np.int32)


def _fingerprint(window: int, gram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            seqs, counts, parts, sizes = [], [], [], []
            for raw in b.column("body").to_pylist():
                words = raw.split()
                seqs.append(_digest(b" ".join(words)))
                counts.append(len(words))
                if len(words) >= window:
                    parts.append(anchors_of(words, window, gram))
                    sizes.append(len(parts[-1][0]))
                else:
                    sizes.append(0)
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64 if i == 0 else np.int32) for i in range(4)]
            items = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["hash", "pos", "lo", "hi"])
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([s[0] for s in seqs], pa.int64()), pa.array([s[1] for s in seqs], pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, items)],
                names=["doc_id", "seq_a", "seq_b", "n_words", "anchors"],
            )

    return run


def _windows(window: int):
    """Digests of the windows lo..hi of each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, starts, out = [], [], []
            for doc, raw, spans in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), b.column("spans").to_pylist()):
                words = raw.split()
                buf = memoryview(b" ".join(words))
                size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                ends = np.cumsum(size)
                begins = (ends - size).tolist()
                ends = (ends - 1).tolist()
                at = [s for x in spans for s in range(x["lo"], x["hi"] + 1)]
                out.extend(digest(buf[begins[s] : ends[s + window - 1]]) for s in at)
                ids.extend([doc] * len(at))
                starts.extend(at)
                if len(out) >= 200_000:
                    yield batch(ids, starts, out)
                    ids, starts, out = [], [], []
            if out:
                yield batch(ids, starts, out)

    def batch(ids, starts, out):
        import numpy as np
        import pyarrow as pa

        d = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=["doc_id", "start", "wa", "wb"])

    return run


class WindowIndex:
    """Runs of (hash, doc_id, pos, lo, hi) sorted by hash, and of the word sequences' digests, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, max_runs: int = 4):
        ship(spark)
        self.spark, self.path, self.window, self.gram, self.max_runs = spark, path or shared_dir(spark) + "-index", window, gram, max_runs
        self.runs: list[str] = []
        self.seqs: list[str] = []
        self.made = 0

    def _write(self, df: DataFrame, kind: str, key: list[str]) -> str:
        at = f"{self.path}/{kind}-{self.made:05d}"
        self.made += 1
        df.sortWithinPartitions(*key).write.option("compression", "zstd").parquet(at)
        return at

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """Index a batch; its removals (doc_id, starts; null starts: the whole text is a copy).

        ``store`` holds the texts of this and all earlier batches, for verification.
        """
        w = self.window
        fp = materialize(batch.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).mapInArrow(trimmed(_fingerprint(w, self.gram)), _ANCHORS), "fp")
        long_enough = fp.where(F.col("n_words") >= w)
        seq_schema, run_schema = "seq_a long, seq_b long, first long", "hash long, doc_id long, pos int, lo int, hi int"
        now = long_enough.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("first"))
        old = self._read(self.seqs, seq_schema).groupBy("seq_a", "seq_b").agg(F.min("first").alias("old"))
        first = now.join(old, ["seq_a", "seq_b"], "left").select("seq_a", "seq_b", F.least("first", "old").alias("first"))
        self.seqs.append(self._write(first, "seq", ["seq_a"]))
        first = self._read(self.seqs[-1:], seq_schema)
        slim = long_enough.select("doc_id", "seq_a", "seq_b").join(first, ["seq_a", "seq_b"])
        copies = slim.where("doc_id > first").select("doc_id").distinct().select("doc_id", F.lit(None).cast("array<int>").alias("starts"))
        # Each word sequence enters by its smallest document, once for each equal row of that; sets drop the repeats.
        fresh = long_enough.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("anchors").alias("a")).select("a.hash", "doc_id", "a.pos", "a.lo", "a.hi")
        new = self._write(fresh, "run", ["hash"])
        run = self._read([new], run_schema)
        every = self._read([*self.runs, new], run_schema)
        shared = every.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash")
        if self.runs:
            shared = shared.join(run.select("hash").distinct(), "hash", "left_semi")
        shared = materialize(shared, "shared")  # apart from the join, whose hot hashes Spark can then split
        spans = every.join(shared, "hash").groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        texts = store.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).join(spans, "doc_id")
        windows = materialize(texts.select("doc_id", "body", "spans").mapInArrow(trimmed(_windows(w)), "doc_id long, start int, wa long, wb long"), "windows")
        firsts = windows.groupBy("wa", "wb").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        firsts = materialize(firsts, "firsts")  # apart from the join, whose hot digests Spark can then split
        cut = windows.join(firsts, ["wa", "wb"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
        if self.runs:
            cut = cut.join(fp.select("doc_id"), "doc_id", "left_semi")
        self.runs.append(new)
        if len(self.runs) > self.max_runs:
            self.compact()
        return cut.unionByName(copies)

    def compact(self) -> None:
        """Merge the runs into one, in the order of the hash."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        merged = self._read(self.runs, "hash long, doc_id long, pos int, lo int, hi int").repartitionByRange(parts, "hash", "doc_id")
        self.runs = [self._write(merged, "run", ["hash"])]
        seqs = self._read(self.seqs, "seq_a long, seq_b long, first long").groupBy("seq_a", "seq_b").agg(F.min("first").alias("first"))
        self.seqs = [self._write(seqs, "seq", ["seq_a"])]


def _apply(window: int, keep_text: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, gone, sha, texts = [], [], [], []
            for raw, starts, copy in zip(b.column("body").to_pylist(), b.column("starts").to_pylist(), b.column("copy").to_pylist()):
                words = raw.split()
                kept = words
                if copy:
                    kept = []
                elif starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array(starts)
                    np.add.at(edge, at, 1)
                    np.subtract.at(edge, at + window, 1)
                    kept = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    texts.append((raw if len(kept) == len(words) else joined).decode("utf-8", "replace"))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(texts, pa.string()), b.column("carry")] if keep_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "carry"][: len(cols)])

    return run


def dedup_substrings(docs: DataFrame, splits: tuple[float, ...] = (), window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    keep_text adds kept_text, and carry: a struct of the row's columns other than its text (and
    had_text: it wasn't null), so that no later join has to move the texts again.

    ``splits``: the documents enter the index in batches of ascending doc_id, cut at these quantiles.
    """
    spark = docs.sparkSession
    index = WindowIndex(spark, window=window, gram=gram)
    cuts = None
    edges = [None, None]
    if splits:
        q = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), list(splits)).alias("q")).first()[0] or []
        edges = [None, *sorted(set(q)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = docs if lo is None else docs.where(F.col("doc_id") > lo)
        part = part if hi is None else part.where(F.col("doc_id") <= hi)
        seen = docs if hi is None else docs.where(F.col("doc_id") <= hi)
        cut = index.add(part, seen)
        cuts = cut if cuts is None else cuts.unionByName(cut)
    carry = F.struct(*(F.col(c) for c in docs.columns if c != "text"), F.col("text").isNotNull().alias("had_text")) if keep_text else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"), carry.alias("carry")).join(cuts.select("doc_id", "starts", F.col("starts").isNull().alias("copy")), "doc_id", "left").select("doc_id", "body", "starts", F.coalesce("copy", F.lit(False)).alias("copy"), *(["carry"] if keep_text else []))
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept_text", "string").add(rows.schema["carry"])
    return rows.mapInArrow(trimmed(_apply(window, keep_text)), schema)
