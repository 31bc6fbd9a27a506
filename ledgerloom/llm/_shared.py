"""Files that driver and executors share, limits on Arrow batches, memory of workers."""

from __future__ import annotations

import ctypes
import uuid
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.shared import shared_dir

ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
X = TypeVar("X")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps
    neither recompute it nor depend on an executor that may be lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that a Python worker gets."""
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns that df doesn't have in any case of letters."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def trimmed(x: X) -> X:
    """x, after the worker has given memory that is free back to the system: workers
    live on from stage to stage, and so would what their allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
    return x
