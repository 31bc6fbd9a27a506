"""Tables of landed pages as rows, with what couldn't be read beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import squash


def table_rows(pages: DataFrame, by: str, page: str, tables: str, cell=squash) -> DataFrame:
    """by, page, tbl, row, cells and error of the tables of each page, which are JSON: an
    array of tables, of rows, of cells.

    What can't be read gives an error and doesn't stop the rest: a document without any
    page (a null page number), a page whose text isn't such an array, a table or a row
    that isn't an array. A page without tables gives no row, a null cell is empty.
    cell: what each cell becomes.
    """
    parsed = lambda c, schema: F.from_json(c, schema)
    # A string of a schema takes a nested value as its JSON text.
    listed = pages.select(by, page, F.col(tables).alias("__t"), parsed(F.col(tables), "array<string>").alias("__tables"))
    split = listed.select(by, page, "__tables", F.posexplode_outer("__tables").alias("tbl", "__table"))
    rows = split.select(by, page, "__tables", "tbl", "__table", parsed(F.col("__table"), "array<string>").alias("__rows"))
    each = rows.select(by, page, "__tables", "tbl", "__rows", F.posexplode_outer("__rows").alias("row", "__row"))
    cells = F.transform(parsed(F.col("__row"), "array<string>"), lambda c: cell(F.coalesce(c, F.lit(""))))
    out = each.withColumn("cells", cells)
    error = _first(
        (F.col(page).isNull(), "document"), (F.col("__tables").isNull(), "page"), (F.col("tbl").isNotNull() & F.col("__rows").isNull(), "table"),
        (F.col("row").isNotNull() & F.col("cells").isNull(), "row"),
    )
    return out.withColumn("error", error).where("error IS NOT NULL OR row IS NOT NULL").select(by, page, "tbl", "row", F.when(F.col("error").isNull(), F.col("cells")).alias("cells"), "error")


def _first(*cases: tuple[Column, str]) -> Column:
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out
