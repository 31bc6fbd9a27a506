"""Micro-batches into a keyed table, as the batch operators would have it.

The table is a log: each batch, reduced to a row a key, is a folder of its own, and
every so many batches all of it is folded into a base. Folding is idempotent, so a base
and batches that it holds already may be read together, and a batch that is tried again
overwrites its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.merge import last_wins
from ledgerloom.sources import commits
from ledgerloom.sources.landing import exists
from ledgerloom.sources.sinks import delete, read_snapshot, write_snapshot

PLACE = "__place"
#: Batches between two bases.
COMPACT_EVERY = 16


def _log(target: str, number: int) -> str:
    return f"{target}/log/batch={number}"


def read_upserted(spark: SparkSession, target: str, keys: list[str], order: list[str], schema=None) -> DataFrame:
    """The rows of the table at target, the last of each key, with the place of its first as
    __place. A table that has had no batch is an error, or with a schema, which holds
    __place, has no rows."""
    parts = [read_snapshot(spark, f"{target}/base")] if commits.version(spark, f"{target}/base") is not None else []
    if exists(spark, f"{target}/log"):
        parts.append(spark.read.parquet(f"{target}/log").drop("batch"))
    if not parts:
        if schema is None:
            raise ValueError(f"no table at {target}")
        return spark.createDataFrame([], schema)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return last_wins(both, keys, order, PLACE)


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: list[str], position: str, compact_every: int = COMPACT_EVERY, files: int | None = None) -> None:
    """Fold all files of source that weren't yet read into the table at target: the last
    row of each key wins, at the place of its first. A batch that is tried again gives
    the same table, and costs as much as it holds itself; the base is rewritten once in
    compact_every batches. files: of the source in a batch, all if null. One stream
    writes a target; its checkpoint must live as long as the target."""

    def fold(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        last_wins(batch.withColumn(PLACE, batch[position]), keys, order, PLACE).write.mode("overwrite").parquet(_log(target, number))
        if (number + 1) % compact_every == 0:
            write_snapshot(read_upserted(own, target, keys, order), f"{target}/base")
            commits.vacuum(own, f"{target}/base")
            # Those of the round before are in the base that readers may still hold, too.
            for old in range(number + 1 - 2 * compact_every, number + 1 - compact_every):
                if old >= 0:
                    delete(own, _log(target, old))

    read = spark.readStream.schema(schema)
    read = read if files is None else read.option("maxFilesPerTrigger", files)
    query = read.parquet(source).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
