"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``, merged from
partial sketches) proposes frequent digests. Their counts and winners are then counted
exactly; those with at least one row in ``HEAVY_SHARE`` rows are broadcast and settle
their rows where they are read. All other digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import fresh, written

#: A digest is frequent if it has more than 1 / HEAVY_SHARE of the rows, so there are fewer than HEAVY_SHARE.
HEAVY_SHARE = 500
#: Counters of the sketch: its error is under 3.5 / SKETCH_ITEMS of the rows.
SKETCH_ITEMS = 16_384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent(digests: DataFrame) -> DataFrame:
    """digest, heavy_keep, heavy_size of the frequent digests; fewer than HEAVY_SHARE rows."""
    rows = digests.count()
    found = digests.selectExpr(f"approx_top_k(hex(digest), {2 * HEAVY_SHARE}, {SKETCH_ITEMS}) t").select(F.explode("t.item").alias("digest"))
    found = written(found.select(F.unhex("digest").alias("digest")), "frequent")
    exact = digests.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("heavy_keep"), F.count("*").alias("heavy_size"))
    return written(exact.where(F.col("heavy_size") > rows / HEAVY_SHARE), "winners")


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so after each run of white space became one space; a
    null text is empty. The smallest id of a group stays. With repeated ids every row
    that has the smallest id counts as kept. A null id stays only if its whole group
    has none. Other columns of df aren't read, whatever their names. An empty table
    gives none.
    """
    text = F.sha2(normalised(F.col(text_col)), 256)
    digests = written(df.select(F.col(id_col).alias("id"), F.unhex(text).alias("digest")), "digests")
    winners = F.broadcast(frequent(digests))
    joined = digests.join(winners, "digest", "left")
    settled = joined.where(F.col("heavy_size").isNotNull()).select("id", "digest", F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"))
    others = joined.where(F.col("heavy_size").isNull()).select("id", "digest")
    # Counted before the shuffle; rows meet their group in a join, whose large partitions are split.
    groups = others.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    found = settled.unionByName(others.join(groups, "digest").select("id", "digest", "keep_id", "group_size"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``group_copies``, that of the smallest id, with df's
    columns, whatever their names. Rows without an id come after all others; of rows
    that share id and text any one stays. An empty table gives none.

    Copies of frequent digests go where they are read; of the others each partition
    sends the first of a digest only.
    """
    digest, keep, size, rank = fresh(df, "digest", "keep", "size", "rank")
    marked = df.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    winners = frequent(marked.select(F.col(id_col).alias("id"), F.col(digest).alias("digest")))
    winners = F.broadcast(winners.toDF(digest, keep, size))
    light = marked.join(winners, digest, "left").where(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    first = F.row_number().over(Window.partitionBy(digest).orderBy(F.col(id_col).asc_nulls_last()))
    return light.withColumn(rank, first).where(F.col(rank) == 1).select(*df.columns)
