"""Landed files to frames with explicit schemas and ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import blank_to


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A headed CSV or TSV file as strings; a byte order mark before the first name is
    no part of it. Missing columns are null, others are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Blank cells of the named columns filled."""
    return df.withColumns({c: blank_to(F.col(c), v) for c, v in defaults.items()})


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lenient: bool = False) -> DataFrame:
    """JSON of a schema; a missing path gives no rows. A corrupt file fails, or gives no rows if lenient."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def read_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """key, value, ord of a file that holds one object, in the order of its keys."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"map<string,{value_schema}>")
    return text.select(F.posexplode(F.map_entries(parsed)).alias("ord", "e")).select("ord", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def below_header(cells: DataFrame, order: str, mark: str, within: int = 10, first: str = "c0", second: str = "c1") -> DataFrame:
    """Rows of landed cells below the header, which is the first of the leading rows
    whose first cell is the mark; an error if there is none. Rows with an empty second
    cell are dropped."""
    header = cells.where((F.col(first) == mark) & (F.col(order) <= within)).agg(F.min(order)).first()[0]
    if header is None:
        raise ValueError(f"no header {mark} in the first {within} rows")
    return cells.where((F.col(order) > header) & (F.coalesce(F.btrim(second), F.lit("")) != ""))


def page_texts(pages: DataFrame, by: str, page: str, text: str) -> DataFrame:
    """The texts of a document's pages joined by line breaks, empty ones skipped."""
    kept = pages.where(F.coalesce(F.col(text), F.lit("")) != "")
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), "\n").alias("text"))


def refuse_empty(df: DataFrame) -> DataFrame:
    """df, or an error if it has no rows: an empty listing isn't an empty source."""
    if df.isEmpty():
        raise ValueError("the batch is empty")
    return df
