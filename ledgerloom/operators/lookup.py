"""Lookups in dimensions: tiers, defaults, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.merge import first_wins


def two_tier(df: DataFrame, dim: DataFrame, exact: tuple[Column, str], coarse: tuple[Column, str], order: list[str], value: str, default: str | None) -> DataFrame:
    """df with value: by the exact key, else by the coarse key's first row, else default.

    exact, coarse: an expression on df and a column of dim. The dimension is reduced to
    a row a key before it is joined; Catalyst broadcasts it if it is small.
    """
    fine = first_wins(dim, [exact[1]], order).select(F.col(exact[1]).alias("__fine"), F.col(value).alias("__a"))
    rough = first_wins(dim, [coarse[1]], order).select(F.col(coarse[1]).alias("__rough"), F.col(value).alias("__b"))
    joined = df.join(fine, exact[0] == F.col("__fine"), "left").join(rough, coarse[0] == F.col("__rough"), "left")
    return joined.withColumn(value, F.coalesce("__a", "__b", F.lit(default))).drop("__fine", "__a", "__rough", "__b")


def enrich(df: DataFrame, more: DataFrame, keys: list[str], columns: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """df with columns of more where they aren't null; defaults fill what stays null."""
    renamed = more.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(renamed, keys, "left")
    for c in columns:
        own = [F.col(c)] if c in df.columns else []
        fill = [F.lit(defaults[c])] if defaults and c in defaults else []
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), *own, *fill)).drop(f"__{c}")
    return joined


#: Letters of a gram by which texts that contain one another meet.
GRAM = 3


def _grams(c: Column, length: int) -> Column:
    """The distinct parts of so many letters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(c) - length + 1)
    return F.when(F.length(c) >= length, F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, length)))).otherwise(F.array().cast("array<string>"))


def _rarest(texts: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """column, __g: of each text the gram of fewest ``counts``; texts with a gram that isn't
    counted are in none of those counted. A text shorter than a gram is its own."""
    own = F.when(F.length(column) < GRAM, F.array(column)).otherwise(_grams(F.col(column), GRAM))
    known = texts.select(column, F.explode(own).alias("__g")).join(counts, "__g", "left")
    best = known.groupBy(column).agg(F.min(F.struct("__n", "__g")).alias("__b"), F.count(F.when(F.col("__n").isNull(), 1)).alias("__none"))
    return best.where("__none = 0").select(column, F.col("__b.__g").alias("__g"))


def _holding(outer: DataFrame, out_col: str, inner: DataFrame, in_col: str) -> DataFrame:
    """out_col, in_col: texts of outer that contain one of inner, which aren't empty. An
    inner text has all its grams in the outer one, so they meet at the rarest."""
    short = [r[0] for r in inner.where(F.length(in_col) < GRAM).select(F.length(in_col)).distinct().collect()]
    parts = F.concat(*(_grams(F.col(out_col), n) for n in (*sorted(short), GRAM)))
    held = outer.select(out_col, F.explode(parts).alias("__g"))
    counts = held.groupBy("__g").agg(F.count("*").alias("__n"))
    return held.join(_rarest(inner, in_col, counts), "__g").where(F.contains(out_col, F.col(in_col))).select(out_col, in_col)


def containment_match(df: DataFrame, id_col: str, key: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """For each row of df the first of names, in order: an equal one, else one of which
    either contains the other; an empty text is in any. Equal texts are matched once;
    others meet at the rarest gram of the contained one, and are then compared. Rows of
    the same id share the best match of any of them."""
    keys = df.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    dim = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(order).alias("__order"))
    some_keys, some_names = keys.where("__key <> ''"), dim.select("__name").where("__name <> ''")
    inside = _holding(some_keys, "__key", some_names, "__name")
    around = _holding(some_names, "__name", some_keys, "__key").select("__key", "__name")
    best = F.min(F.struct(F.when(F.col("__key") == F.col("__name"), 0).otherwise(1).alias("tier"), "__order", "__name"))
    found = inside.unionByName(around).join(dim, "__name").groupBy("__key").agg(best.alias("__m"))
    # An empty name is in every key, and an empty key in every name: one row each.
    whole = dim.agg(F.min(F.struct("__order", "__name")).alias("all"), F.min(F.when(F.col("__name") == "", F.struct("__order", "__name"))).alias("empty")).first()
    given = lambda x, tier: F.lit(None).cast(found.schema["__m"].dataType) if x is None else F.struct(F.lit(tier).alias("tier"), F.lit(x[0]).cast(dim.schema["__order"].dataType).alias("__order"), F.lit(x[1]).alias("__name"))
    any_row, empty = given(whole["all"], 1), given(whole["empty"], 1)
    matched = keys.join(found, "__key", "left")
    matched = matched.select("__key", F.when(F.col("__key") == "", given(whole["empty"], 0) if whole["empty"] is not None else any_row).otherwise(F.least("__m", empty) if whole["empty"] is not None else F.col("__m")).alias("__m"))
    by_id = df.join(matched, df[key] == F.col("__key")).groupBy(id_col).agg(F.min("__m").alias("__m"))
    return df.join(by_id, id_col, "left").withColumn("matched", F.col("__m.__name")).drop("__m")


def known_only(df: DataFrame, key: Column, dim: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in the dimension."""
    return df.join(dim.select(F.col(column).alias("__k")).distinct(), key == F.col("__k"), "left_semi")


def attribute_list(df: DataFrame, id_col: str, names: str, dim: DataFrame, key: str, value: str, default: str | None) -> DataFrame:
    """id, values: the attribute of each name, each once, in order; unknown names give default, or nothing if that is null."""
    listed = df.select(id_col, F.posexplode(names).alias("pos", "__n"))
    joined = listed.join(dim.select(F.col(key).alias("__n"), F.col(value).alias("__v")), "__n", "left").withColumn("__v", F.coalesce("__v", F.lit(default)))
    grouped = joined.where(F.coalesce(F.col("__v"), F.lit("")) != "").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "__v"))).alias("__l"))
    values = F.array_distinct(F.transform(F.col("__l"), lambda x: x["__v"])).alias("values")
    return df.select(id_col).join(grouped.select(id_col, values), id_col, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def next_event(df: DataFrame, by: list[str], at: str, order: list[str], as_of: Column) -> DataFrame:
    """The first row of each group at or after a moment."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    return df.where(F.col(at) >= as_of).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
