"""Counts, pivots, shares, top lists, facets and badges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conditional_counts(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def seeded_counts(df: DataFrame, by: str, groups: DataFrame) -> DataFrame:
    """Rows of each group, 0 for groups without any."""
    return groups.select(by).distinct().join(df.groupBy(by).count(), by, "left").select(by, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def argmax_first(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The row with the largest value of each group, the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), *order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered_collect(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The values of each group in order."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]).alias(out))


def pivot(df: DataFrame, rows: list[str], column: str, values: list, measure: Column, fill: object = 0) -> DataFrame:
    """The measure by rows and the given values of a column."""
    return df.groupBy(*rows).pivot(column, values).agg(measure).na.fill(fill)


def drilldown(df: DataFrame, cell: dict[str, object]) -> DataFrame:
    """The rows behind a cell of a pivot; a null value selects nulls."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in cell.items()), F.lit(True)))


def shares(df: DataFrame, by: list[str], measure: Column, within: list[str] | None = None, digits: int = 4) -> DataFrame:
    """value of each group and its share of the total, or of its group within."""
    grouped = df.groupBy(*by).agg(measure.alias("value"))
    return grouped.withColumn("share", F.round(F.col("value") / F.sum("value").over(Window.partitionBy(*(within or []))), digits))


def top_with_series(df: DataFrame, by: str, period: Column, k: int) -> DataFrame:
    """by, total, period, n: counts in time of the k groups with most rows, ties by name."""
    top = df.groupBy(by).agg(F.count("*").alias("total")).orderBy(F.desc("total"), by).limit(k)
    return df.withColumn("period", period).join(F.broadcast(top), by).groupBy(by, "total", "period").agg(F.count("*").alias("n"))


def representation(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """n by outer and inner, with the subtotals of each outer and the total (nulls)."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"))


def faceted(df: DataFrame, equal: dict[str, list] | None = None, between: dict[str, tuple] | None = None, text: tuple[str, str] | None = None, holds: dict[str, object] | None = None, first: dict[str, object] | None = None, later: dict[str, object] | None = None) -> DataFrame:
    """Rows that meet every facet given: one of some values, a closed range, text
    without regard to case, an element of an array, its first, or one after the first."""
    tests = [F.col(c).isin(*v) for c, v in (equal or {}).items()]
    tests += [F.col(c).between(*v) for c, v in (between or {}).items()]
    tests += [F.contains(F.lower(text[0]), F.lit(text[1].lower()))] if text else []
    tests += [F.array_contains(c, v) for c, v in (holds or {}).items()]
    tests += [F.get(F.col(c), F.lit(0)) == F.lit(v) for c, v in (first or {}).items()]
    tests += [F.array_position(F.slice(F.col(c), F.lit(2), F.greatest(F.size(c), F.lit(1))), v) > 0 for c, v in (later or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def conditional_facet(df: DataFrame, kinds: list[str], only: str, kind_col: str, state: Column) -> DataFrame:
    """A facet that exists only while the kind filter is exactly one kind."""
    if kinds != [only]:
        raise ValueError(f"this facet needs {kind_col} to be {only} alone")
    return df.where(F.col(kind_col) == only).where(state)


def badges(df: DataFrame, events: DataFrame, key: str, flags: dict[str, Column], texts: dict[str, tuple[str, str]]) -> DataFrame:
    """df with flags (whether any event of the key has it) and texts (a column of the
    key's event with the largest order)."""
    # An order may hold equal values: the text itself breaks the tie.
    found = events.groupBy(key).agg(*(F.bool_or(c).alias(n) for n, c in flags.items()), *(F.max(F.struct(o, F.col(c).alias("__t")))["__t"].alias(n) for n, (c, o) in texts.items()))
    joined = df.join(found, key, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in flags})


def attach(df: DataFrame, events: DataFrame, key: str, item: list[str], order: list[str], out: str) -> DataFrame:
    """df with an array of the events of its key, in order; empty without any."""
    kinds = dict(events.dtypes)
    empty = f"array<struct<{','.join(f'{i}:{kinds[i]}' for i in item)}>>"
    rows = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*item).alias("__i")))), lambda x: x["__i"]).alias(out))
    return df.join(rows, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(empty)))


def sort_recent(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Descending by columns, ties in the order of the input."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in columns), *order)


def numeric_or_zero(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(0)


def _values(df: DataFrame, c: Column) -> Column:
    """array<struct<value, first>> of a scalar or of an array's elements as text; first marks
    the first of equal elements. Nulls count as no element, none as one null."""
    kind = df.select(c.alias("c")).schema["c"].dataType
    listed = F.filter(c.cast("array<string>"), lambda x: x.isNotNull()) if isinstance(kind, T.ArrayType) else F.filter(F.array(c.cast("string")), lambda x: x.isNotNull())
    marked = F.transform(listed, lambda x, i: F.struct(x.alias("value"), (F.array_position(listed, x) == i + 1).alias("first")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(True).alias("first")))
    return F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, marked).otherwise(nothing)


def all_pivots(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """row_dim, column_dim, row, column, records, elements: the cells of the pivots of any
    two of the dims, in their order, by one scan and one shuffle. A dim may be an array:
    a record counts once in a cell, its elements as often as they are there. Empty arrays
    and nulls have the value null."""
    names = list(dims)
    values = df.select(*(_values(df, c).alias(f"d{k}") for k, c in enumerate(dims.values())))

    def cells(i: int, j: int) -> Column:
        cell = lambda a, b: F.struct(F.lit(names[i]).alias("row_dim"), F.lit(names[j]).alias("column_dim"), a["value"].alias("row"), b["value"].alias("column"), (a["first"] & b["first"]).cast("int").alias("own"))
        return F.flatten(F.transform(F.col(f"d{i}"), lambda a: F.transform(F.col(f"d{j}"), lambda b: cell(a, b))))

    pairs = F.explode(F.flatten(F.array(*(cells(i, j) for i in range(len(names)) for j in range(i + 1, len(names))))))
    grouped = values.select(pairs.alias("c")).groupBy("c.row_dim", "c.column_dim", "c.row", "c.column")
    return grouped.agg(F.sum("c.own").alias("records"), F.count("*").alias("elements"))


def cross_filtered(df: DataFrame, charts: dict[str, tuple[Column, ...]], choices: dict[str, Column], top: dict[str, int] | None = None, digits: int = 4) -> DataFrame:
    """chart, key, part, n, share, rank: the bars, slices or points of each chart under the
    choices made in all other charts.

    charts: one or two dims, of which the first may be an array; choices: a condition by
    the name of the chart in which it was made, null counting as not met. A record has a
    bit for each choice that it fails, so that one scan and one aggregate serve all
    charts. share is n over that of the chart's key (of the chart, with one dim), rank
    orders keys by n and then by name; top keeps the first so many keys of a chart.
    """
    bit = {name: 1 << k for k, name in enumerate(choices)}
    failed = reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), 0).otherwise(bit[name]) for name, c in choices.items()), F.lit(0))
    values = {name: (_values(df, dims[0]), (dims[1].cast("string") if len(dims) > 1 else F.lit(None).cast("string"))) for name, dims in charts.items()}
    prepared = df.select(failed.alias("failed"), *(F.struct(v.alias("keys"), part.alias("part")).alias(f"c{k}") for k, (v, part) in enumerate(values.values())))

    def marks(k: int, name: str) -> Column:
        mark = lambda v: F.struct(F.lit(name).alias("chart"), v["value"].alias("key"), F.col(f"c{k}.part").alias("part"))
        seen = F.transform(F.filter(F.col(f"c{k}.keys"), lambda v: v["first"]), mark)
        return F.when(F.col("failed").isin(0, bit.get(name, 0)), seen).otherwise(F.slice(seen, 1, 0))

    shown = prepared.select(F.explode(F.flatten(F.array(*(marks(k, name) for k, name in enumerate(charts))))).alias("m"))
    counted = shown.groupBy("m.chart", "m.key", "m.part").agg(F.count("*").alias("n"))
    of_key = counted.withColumn("__k", F.sum("n").over(Window.partitionBy("chart", "key")))
    nested = F.col("chart").isin(*(name for name, dims in charts.items() if len(dims) > 1))
    whole = F.sum("n").over(Window.partitionBy("chart"))
    ranked = of_key.withColumn("share", F.round(F.col("n") / F.when(nested, F.col("__k")).otherwise(whole), digits)).withColumn("rank", F.dense_rank().over(Window.partitionBy("chart").orderBy(F.desc("__k"), F.col("key").asc_nulls_last())))
    kept = reduce(lambda c, t: c & ((F.col("chart") != t[0]) | (F.col("rank") <= t[1])), (top or {}).items(), F.lit(True))
    return ranked.where(kept).select("chart", "key", "part", "n", "share", "rank")
