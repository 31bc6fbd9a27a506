"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, the folder that stands in for a setting that is absent.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir. Where that is unset, a temporary one on local
    masters, the same for all calls of an application; elsewhere executors couldn't see
    it, so that is a ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _OWN[context.applicationId]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so that those who use it twice
    neither compute it twice nor plan it twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
