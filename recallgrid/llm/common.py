"""Helpers shared by the training-data operators."""
from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + os.path.join(tempfile.gettempdir(), "recallgrid-checkpoints")
    return f"{base.rstrip('/')}/rg-{uuid.uuid4().hex[:16]}"


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(col: str = "text"):
    """The text's UTF-8 bytes, null as empty: Python workers then need no decoding."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


_state: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between tasks: one operator's tables at a time, as workers are reused."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def drop_state(key=None) -> None:
    """Forget what other operators left in this worker."""
    for other in [k for k in _state if k != key]:
        del _state[other]


def trimmed(run, key=None):
    """The Arrow function, giving freed memory back after each task: idle workers outlive their stage.

    ``key``: the function's own worker_state; what any other operator kept goes first.
    """

    def bounded(batches):
        import ctypes
        import gc

        import pyarrow as pa

        drop_state(key)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return bounded


def by_bytes(*columns, limit: int = 2_000_000):
    """Lists of slices of Arrow columns of which the last holds texts: about ``limit`` bytes each, made one at a time."""
    import numpy as np
    import pyarrow.compute as pc

    end = np.cumsum(pc.binary_length(columns[-1]).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = done = 0
    while start < len(end):
        stop = min(int(np.searchsorted(end, done + limit)) + 1, len(end))
        yield tuple(c.slice(start, stop - start).to_pylist() for c in columns)
        start, done = stop, int(end[stop - 1])
