"""An inverted index of the texts of a table, for facets that look for a piece of text.

The index is a table of versions (``commits``) beside the one that it serves: postings
(gram of three characters, key) in folders by a hash of the gram, and how many rows of
a gram each update added. Rows that change append postings; those of their old texts stay
and cost a look, as what the index proposes is verified on the table itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.html import let
from ledgerloom.sources import commits
from ledgerloom.sources.landing import exists

#: Characters of a gram.
GRAM = 3
#: Folders of an index.
BUCKETS = 256
#: Of the grams of what is looked for, so many of the rarest are read.
READ = 4


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in lower case; none if it is shorter or null."""
    run = lambda chars, i: F.concat(*(F.get(chars, i + k) for k in range(GRAM)))
    runs = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: run(chars, i))
    return F.when(F.length(text) >= GRAM, F.array_distinct(let(F.split(F.lower(text), ""), runs))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    found = rows.select(F.col(key).alias("key"), F.explode(grams(F.col(text))).alias("gram"))
    return found.withColumn("bucket", _bucket(F.col("gram")))


def update(spark: SparkSession, path: str, changed: DataFrame, key: str, text: str, rebuild: bool = False) -> int:
    """Add the texts of new and changed rows to the index at path; the number of its new
    version. rebuild: these are all rows, and what the index held goes, stale postings
    with it. Rows without a key aren't found by it. Rows that go from the table need no
    update. An update that is tried again costs looks, not results."""
    posted = _postings(changed.where(F.col(key).isNotNull()), key, text)
    # Folders that a frequent gram makes large are written by several tasks.
    dealt = posted.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
    frames = {"postings": dealt, "counts": posted.groupBy("gram").agg(F.count("*").alias("n")).sort("gram")}
    return commits.commit(spark, path, frames if rebuild else {}, None if rebuild else frames, folders={"postings": ["bucket"]})


def proposed(spark: SparkSession, path: str, needle: str, kind: str = "string") -> DataFrame | None:
    """Keys (of this kind, if there are none) of rows whose text may hold the needle, each
    once; null if the index can't tell: the needle is shorter than a gram. Only folders
    of the grams that are looked for are listed and read."""
    asked = dict(map(tuple, spark.range(1).select(F.explode(grams(F.lit(needle))).alias("gram")).select("gram", _bucket(F.col("gram"))).collect()))
    if not asked:
        return None
    known = {r.gram: r.n for r in commits.read(spark, path, "counts").where(F.col("gram").isin(list(asked))).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rarest = sorted(asked, key=lambda g: (known.get(g, 0), g))[:READ]
    folders = [f"{path}/{f}/bucket={b}" for f in commits.tables(spark, path)["postings"] for b in sorted({asked[g] for g in rarest})]
    there = [f for f in folders if exists(spark, f)]
    if not all(g in known for g in asked) or not there:
        return spark.createDataFrame([], f"key {kind}")
    bit = reduce(lambda c, p: c.when(F.col("gram") == p[1], F.lit(1 << p[0])), enumerate(rarest), F.when(F.lit(False), F.lit(0)))
    found = spark.read.parquet(*there).where(F.col("gram").isin(rarest)).groupBy("key").agg(F.bit_or(bit).alias("held"))
    return found.where(F.col("held") == (1 << len(rarest)) - 1).select("key")


def search(spark: SparkSession, path: str, table: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Rows of the table whose text holds the needle without regard to case: those that
    the index proposes, verified, or all, where it can't tell. Rows that went from the
    table since the last update don't matter, those that came or changed do. Rows without
    a key aren't found, whatever the needle."""
    held = F.contains(F.lower(text), F.lower(F.lit(needle))) & F.col(key).isNotNull()
    keys = proposed(spark, path, needle, dict(table.dtypes)[key])
    return (table if keys is None else table.join(keys, table[key] == F.col("key"), "left_semi")).where(held)
