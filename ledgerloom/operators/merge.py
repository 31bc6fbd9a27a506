"""Dedup, incremental merge and state by key, with explicit order of rows.

Keys and orders are lists of column names. Orders must be total for a result that
doesn't depend on partitioning. Null keys are a key of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.values import truthy


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], order: list[str], position: str | None = None) -> DataFrame:
    """The last row of each key; position: gets the place of the key's first row. Both are
    found before the shuffle too, so a key of many rows sends one a task."""
    if position is None:
        return first_wins(df, keys, [F.col(o).desc() for o in order])
    last = F.max_by(F.struct(*df.columns), F.struct(*order))
    found = df.groupBy(*keys).agg(last.alias("__row"), F.min(position).alias("__first")).select("__row.*", "__first")
    return found.withColumn(position, F.col("__first")).drop("__first")


def priority_union(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of first, its last of each key winning, and of second only for keys that first lacks, its first winning."""
    both = first.withColumn("__rank", F.lit(0)).unionByName(second.withColumn("__rank", F.lit(1)))
    within = [F.when(F.col("__rank") == 0, F.col(o)).desc_nulls_last() for o in order] + [F.col(o) for o in order]
    return first_wins(both, keys, [F.col("__rank"), *within]).drop("__rank")


def only_new(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose key isn't known."""
    return batch.join(known.select(*keys).distinct(), keys, "left_anti")


def past_watermark(batch: DataFrame, done: DataFrame, id_col: str, watermark: int | None) -> DataFrame:
    """Rows above the watermark that aren't among the done ids."""
    above = batch if watermark is None else batch.where(F.col(id_col) > watermark)
    return only_new(above, done, [id_col])


def watermark(done: DataFrame, batch: DataFrame, id_col: str) -> DataFrame:
    """One row with the largest id of both as watermark, null without any."""
    return done.select(id_col).unionByName(batch.select(id_col)).agg(F.max(id_col).alias("watermark"))


def baseline(batch: DataFrame, state: DataFrame, keys: list[str], status: str = "baseline") -> DataFrame:
    """state with the keys of batch that it lacks marked as done without being applied."""
    new = only_new(batch.select(*keys).distinct(), state, keys).withColumn("status", F.lit(status))
    return state.unionByName(new, allowMissingColumns=True)


def _matched(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    a, b = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    same = reduce(lambda x, y: x & y, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    return a.join(b, same, "full_outer"), F.col("__old").isNotNull(), F.col("__new").isNotNull()


def upsert_overwrite(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the listed columns of new, nulls too, and rows of new keys; outcome says what happened."""
    joined, was, comes = _matched(old, new, keys)
    changed = reduce(lambda x, y: x | y, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns), F.lit(False))
    value = lambda c: F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else (F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}"))
    keyed = [F.when(was, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    outcome = F.when(~was, "inserted").when(~comes, "kept").when(changed, "updated").otherwise("unchanged")
    return joined.select(*keyed, *(value(c).alias(c) for c in old.columns if c not in keys), outcome.alias("outcome"))


def upsert_latch(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], silent: tuple[str, ...] = ()) -> DataFrame:
    """old where only values of new that are given overwrite; changed says whether one
    of another column than the silent ones did. Keys that old lacks aren't added."""
    kinds = dict(new.dtypes)
    a, b = old.alias("o"), new.alias("n")
    same = reduce(lambda x, y: x & y, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    joined = a.join(b, same, "left")
    given = {c: truthy(F.col(f"n.{c}"), kinds[c]) for c in columns}
    changed = reduce(lambda x, y: x | y, (given[c] & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns if c not in silent), F.lit(False))
    return joined.select(*((F.when(given[c], F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")).alias(c) for c in old.columns), changed.alias("changed"))


def upsert_partial(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], together: dict[str, list[str]]) -> DataFrame:
    """old with rows of new keys added. Columns of keep change where new's value isn't
    null; where a column that heads an entry of together is known in new, it and its
    followers are overwritten, the followers possibly by null."""
    joined, was, comes = _matched(old, new, keys)
    leads = {f: head for head, follow in together.items() for f in (head, *follow)}

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in leads:
            return F.when(F.col(f"n.{leads[c]}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}")

    keyed = [F.when(was, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    return joined.select(*keyed, *(value(c).alias(c) for c in old.columns if c not in keys))


def canonical_spelling(df: DataFrame, raw: str, key: Column, order: list[str], default: str, out: str) -> DataFrame:
    """out: of each key the spelling that comes first, default for blank ones. Spellings
    are few against rows, so they are found by an aggregate and joined."""
    keyed = df.withColumn("__key", key)
    first = keyed.where(F.coalesce(F.col(raw), F.lit("")) != "").groupBy("__key").agg(F.min(F.struct(*order, raw)).alias("__f")).select("__key", F.col(f"__f.{raw}").alias(out))
    return keyed.join(first, "__key", "left").drop("__key").withColumn(out, F.when(F.coalesce(F.col(raw), F.lit("")) == "", default).otherwise(F.col(out)))
