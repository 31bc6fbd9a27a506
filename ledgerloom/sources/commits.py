"""Versions of several tables that change together.

Rows are written to folders of their own first. A version is a numbered manifest that
names the folders of each table; it is created only if there is none of its number, and
the largest complete one is current. So a run that is killed at any point leaves the old
tables or the new ones, and of two runs that commit at once one fails.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "manifests", "data"


class Conflict(RuntimeError):
    """Another run has committed in between."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    _, place, fs = _fs(spark, path)
    return list(fs.listStatus(place)) if fs.exists(place) else []


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest; null if it isn't complete."""
    _, place, fs = _fs(spark, path)
    source = fs.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("complete") else None


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that doesn't exist yet."""
    jvm, place, fs = _fs(spark, path)
    try:
        out = fs.create(place, False)
    except Exception as e:  # the file system's own kinds of error reach Python as one
        if fs.exists(place):
            raise Conflict(f"{path} is there already") from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all manifests, complete or not, the largest first."""
    names = [s.getPath().getName() for s in _listed(spark, f"{path}/{MANIFESTS}")]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _file(path: str, number: int) -> str:
    return f"{path}/{MANIFESTS}/{number:012d}.json"


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the current version, null without one."""
    return next((n for n in _numbers(spark, path) if _read(spark, _file(path, n))), None)


def tables(spark: SparkSession, path: str, number: int | None = None) -> dict[str, list[str]]:
    """The folders of each table in a version, the current one if none is given; empty without any."""
    number = version(spark, path) if number is None else number
    found = None if number is None else _read(spark, _file(path, number))
    return found["tables"] if found else {}


def read(spark: SparkSession, path: str, table: str, number: int | None = None) -> DataFrame:
    """A table in a version, the current one if none is given."""
    folders = [f"{path}/{f}" for f in tables(spark, path, number).get(table, [])]
    if not folders:
        raise ValueError(f"no table {table} at {path}")
    if not any("=" in s.getPath().getName() for s in _listed(spark, folders[-1])):
        return spark.read.parquet(*folders)
    # Columns that are folders are found below one root at a time.
    return reduce(DataFrame.unionByName, (spark.read.parquet(f) for f in folders))


def commit(
    spark: SparkSession,
    path: str,
    replaced: dict[str, DataFrame],
    appended: dict[str, DataFrame] | None = None,
    base: int | None = None,
    dry_run: bool = False,
    folders: dict[str, list[str]] | None = None,
) -> int | None:
    """Write frames and make them current together; the number of the new version.

    replaced: tables that become these rows, whole; appended: rows added to tables.
    Other tables stay as they are. base: the version that the frames were made from; if
    another one is current by now, that is a Conflict and nothing changes. dry_run
    writes and commits nothing. Rows keep the order of their frames in their files.
    folders: by table, columns whose values become folders, so that readers that filter by
    them list no others.
    """
    if dry_run:
        return None
    before = version(spark, path)
    if base is not None and before != base:
        raise Conflict(f"version {before} is current at {path}, not {base}")
    found = dict(tables(spark, path, before)) if before is not None else {}
    for table, df, kept in [*((t, d, False) for t, d in replaced.items()), *((t, d, True) for t, d in (appended or {}).items())]:
        folder = f"{DATA}/{table}-{uuid.uuid4().hex}"
        df.write.partitionBy(*(folders or {}).get(table, [])).parquet(f"{path}/{folder}")
        found[table] = [*(found.get(table, []) if kept else []), folder]
    now = version(spark, path)
    if now != before:
        raise Conflict(f"version {now} is current at {path}, not {before}")
    # A manifest that a killed run left incomplete keeps its number.
    number = max(_numbers(spark, path), default=0) + 1
    _create(spark, _file(path, number), json.dumps({"tables": found, "complete": True}))
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86400.0) -> int:
    """Delete all versions but the latest ``keep`` complete ones and folders that no
    version names, if they are older than so many seconds: younger ones may belong to a
    run that is about to commit. How many folders went."""
    complete = [n for n in _numbers(spark, path) if _read(spark, _file(path, n))]
    kept = complete[: max(1, keep)]
    named = {f for n in kept for folders in tables(spark, path, n).values() for f in folders}
    limit, gone = (time.time() - older_than) * 1000, 0
    for n in _numbers(spark, path):
        if kept and n < kept[-1]:
            _, place, fs = _fs(spark, _file(path, n))
            fs.delete(place, False)
    for status in _listed(spark, f"{path}/{DATA}"):
        name = f"{DATA}/{status.getPath().getName()}"
        if name not in named and status.getModificationTime() <= limit:
            _, place, fs = _fs(spark, f"{path}/{name}")
            gone += bool(fs.delete(place, True))
    return gone
