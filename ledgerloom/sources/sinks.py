"""Frames to files: sorted snapshots and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import commits


ROWS = "rows"


def write_snapshot(df: DataFrame, path: str, recent: list[str] | None = None, order: list[str] | None = None) -> int:
    """Write a new version below path and make it the current one; readers of the old
    version aren't disturbed, and a run that is killed leaves it current. recent:
    columns sorted by descending."""
    from ledgerloom.operators.analytics import sort_recent

    return commits.commit(df.sparkSession, path, {ROWS: sort_recent(df, recent, order or []) if recent else df})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return commits.read(spark, path, ROWS)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that isn't there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def state_rows(df: DataFrame, id_col: str) -> DataFrame:
    """One row with the distinct ids, sorted as text."""
    return df.agg(F.array_sort(F.collect_set(F.col(id_col).cast("string"))).alias("processed"))


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def dry_run(batches: DataFrame, order: str, on: bool) -> DataFrame:
    """The first batch only, if on."""
    return batches.orderBy(order).limit(1) if on else batches
