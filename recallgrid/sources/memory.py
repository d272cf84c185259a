"""The memory tables, derived from the vector and event tables by fixed rules, and file readers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = ("txt", "md", "markdown", "json", "csv", "log")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("org"), (v % 3).cast("string")).alias("org_id"), v.alias("slot_id"), F.concat(F.lit("memory "), v.cast("string"), F.lit(" topic "), F.col("label").cast("string")).alias("text"),
        F.col("embedding").alias("vector"), ((v * 7919) % 256).alias("entity_bitmap"), (v % 4).cast("int").alias("layer"), (v * 1000).alias("created_at_ns"), ((v * 37) % 1000 * 1000).alias("valid_from_ns"),
        (v % 11 == 0).alias("tombstoned"), (v % 7 == 0).alias("superseded"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: two from each memory."""
    v = F.col("vec_id")
    out = table(spark, sf_dir, "embeddings").select(v, F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    dst = F.when(F.col("seq") == 0, F.floor(v / 2)).otherwise(F.floor(v / 3) + 1)
    return out.select(v.alias("src"), dst.cast("long").alias("dst"), (v % 6 + 1).cast("int").alias("edge_type"), ((v * 31) % 256).cast("int").alias("weight"), "seq")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write log over the event table: inserts, rewrites, deletes."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "rewrite").otherwise("insert")
    return e.select(F.col("event_id").alias("op_seq"), F.col("user_id").alias("slot_id"), op.alias("op"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log by user: the hash of each entry covers the one before."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("org"), (F.col("user_id") % 10).cast("string")).alias("org_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("slot_id"), F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def text_files(spark: SparkSession, path: str, extensions=TEXT_EXTENSIONS) -> DataFrame:
    """path, text of the files below ``path`` whose extension is listed, in any case."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(ext.isin(*extensions)).select("path", F.decode("content", "UTF-8").alias("text"))


def skipped_files(spark: SparkSession, path: str, extensions=TEXT_EXTENSIONS) -> DataFrame:
    """How many files of each other extension there are."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    return files.select(ext.alias("ext")).where(~F.col("ext").isin(*extensions)).groupBy("ext").count().orderBy(F.desc("count"), "ext")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or fail when strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def f32_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Rows of little-endian float32 vectors: path, row, vector."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                m = np.frombuffer(raw, "<f4").reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(m), pa.string()), pa.array(np.arange(len(m))), pa.array(m.tolist(), pa.list_(pa.float32()))], names=["path", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row long, vector array<float>")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Length-prefixed (u32, little-endian) UTF-8 records: path, row, text."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                out, at = [], 0
                while at + 4 <= len(raw):
                    n = int.from_bytes(raw[at : at + 4], "little")
                    out.append(raw[at + 4 : at + 4 + n].decode("utf-8", "replace"))
                    at += 4 + n
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(out), pa.string()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.string())], names=["path", "row", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row long, text string")


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot_id, text: records as JSON for most memories, prose or broken JSON for the rest."""
    v = F.col("vec_id")
    tags = F.concat(F.lit('["topic:'), F.col("label").cast("string"), F.lit('","mod:'), (v % 3).cast("string"), F.lit('"]'))
    latest = F.when(v % 5 == 0, F.lit(',"is_latest":false')).otherwise(F.lit(""))
    title = F.when(v % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("title "), v.cast("string")))
    text = F.concat(F.lit('{"id":"m'), v.cast("string"), F.lit('","title":"'), title, F.lit('","content":"body '), v.cast("string"), F.lit('","tags":'), tags, latest, F.lit("}"))
    prose = F.concat(F.lit("note "), v.cast("string"))
    return table(spark, sf_dir, "embeddings").select(v.alias("slot_id"), F.when(v % 7 == 0, prose).otherwise(text).alias("text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot_id, text: records of a code base's history, tagged by kind and file."""
    v = F.col("vec_id")
    kinds = F.element_at(F.array(*map(F.lit, ("decision", "refactor", "bug", "fix", "gotcha", "other"))), (v % 6 + 1).cast("int"))
    more = F.when(v % 9 == 0, F.lit(',"decision"')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"id":"n'), v.cast("string"), F.lit('","title":"note '), kinds, F.lit('","content":"file f'), (v % 5).cast("string"), F.lit(" item "), v.cast("string"), F.lit('","tags":["'), kinds, F.lit('","file:f'), (v % 5).cast("string"), F.lit('"'), more, F.lit("]}"))
    return table(spark, sf_dir, "embeddings").select(v.alias("slot_id"), text.alias("text"))
