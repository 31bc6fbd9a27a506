"""Rows of the 39-column workbook as records and agreements. A row is an array of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import after_colon, author_list, blank_to, dash_parts, labelled, main_authors, record_url, strip, without_author_prefix, words
from ledgerloom.functions.values import approved, date_or_null, found, law_and_date, status_flags
from ledgerloom.operators.extract import group_columns, hyperlink
from ledgerloom.operators.merge import first_wins, only_new

# The places of cells, from 0.
ORIGIN, NUMBER, YEAR, KIND, TITLE, ENTRY, LAPSED, FILED, DESK, AUTHORS = 0, 1, 2, 3, 4, 5, 6, 7, 8, 13
BODIES = (15, 19, 23, 27, 31)
ORDER, OUTCOME, LAW, ARCHIVED = 34, 35, 36, 38


def _cell(cells: Column, at: int) -> Column:
    """A cell without white space around it, empty for a null."""
    return strip(F.coalesce(F.get(cells, F.lit(at)), F.lit("")))


def _shown(cells: Column, at: int) -> Column:
    return strip(hyperlink(_cell(cells, at))["text"])


def record(cells: Column, labels: dict[str, str]) -> Column:
    """The record of a row: number, year, kind, kind_label, extract, authors, coauthors,
    bodies, date, entry, origin, url and its state. Without a number or year these are
    null. The date of the desk counts only if it is one; a record is archived by its last
    column, else by its eighth; lapsing alone doesn't archive it."""
    year, title = _shown(cells, YEAR).try_cast("int"), _cell(cells, TITLE)
    # Bound by a transform of one item, the authors are worked out once.
    of = F.get(F.transform(F.array(author_list(_cell(cells, AUTHORS))), lambda a: main_authors(title, a)), F.lit(0))
    entry, desk = F.get(dash_parts(_cell(cells, ENTRY)), F.lit(0)), F.get(dash_parts(_cell(cells, DESK)), F.lit(0))
    archived, lapsed = F.coalesce(date_or_null(_cell(cells, ARCHIVED)), date_or_null(_cell(cells, FILED))), date_or_null(_cell(cells, LAPSED))
    law = law_and_date(_cell(cells, LAW))
    flags = status_flags(archived, lapsed, law["number"])
    return F.struct(
        _shown(cells, NUMBER).try_cast("int").alias("number"),
        year.alias("year"),
        _cell(cells, KIND).alias("kind"),
        labelled(_cell(cells, KIND), labels).alias("kind_label"),
        without_author_prefix(title, of["main"]).alias("extract"),
        of["main"].alias("authors"),
        of["others"].alias("coauthors"),
        F.filter(F.array(*(_cell(cells, k) for k in BODIES)), lambda b: b != "").alias("bodies"),
        F.coalesce(date_or_null(desk), F.lit("")).alias("date"),
        F.coalesce(F.concat(entry, F.lit("/"), year.cast("string")), F.lit("")).alias("entry"),
        _cell(cells, ORIGIN).alias("origin"),
        hyperlink(_cell(cells, YEAR))["url"].alias("url"),
        flags["enacted"].alias("enacted"),
        law["number"].alias("law"),
        law["date"].alias("law_date"),
        flags["archived"].alias("archived"),
        archived.alias("archived_on"),
        flags["lapsed"].alias("lapsed"),
        lapsed.alias("lapsed_on"),
    )


def agreement(cells: Column) -> Column:
    """The agreement of a row: number, year, title, origin, entry, announced and its date,
    approved and its date, order. Two words in the entry's cell announce it; it is
    approved if both its order's third word and its outcome say so."""
    entry, order, outcome = dash_parts(_cell(cells, ENTRY)), dash_parts(_shown(cells, ORDER)), words(_cell(cells, OUTCOME))
    at = lambda a, k: F.get(a, F.lit(k))
    passed = approved(F.coalesce(at(order, 2), F.lit("")), F.coalesce(at(outcome, 0), F.lit("")))
    return F.struct(
        _shown(cells, NUMBER).try_cast("int").alias("number"),
        _shown(cells, YEAR).try_cast("int").alias("year"),
        _cell(cells, TITLE).alias("title"),
        _cell(cells, ORIGIN).alias("origin"),
        at(entry, 0).try_cast("int").alias("entry"),
        (F.size(entry) >= 2).alias("announced"),
        at(entry, 1).alias("announced_on"),
        passed.alias("approved"),
        F.when(passed, at(outcome, 1)).alias("approved_on"),
        at(order, 0).try_cast("int").alias("order"),
    )


def records(rows: DataFrame, cells: str, labels: dict[str, str]) -> DataFrame:
    """The records of landed rows whose kind is known by its label, with their other columns."""
    kinds = [F.lit(k) for k in labels]
    return rows.where(_cell(F.col(cells), KIND).isin(*kinds)).withColumn("r", record(F.col(cells), labels)).select(*(c for c in rows.columns if c != cells), "r.*")


def approved_records(rows: DataFrame, cells: str, labels: dict[str, str]) -> DataFrame:
    """The records of landed rows that name any kind, known or not, with their other columns."""
    return rows.where(_cell(F.col(cells), KIND) != "").withColumn("r", record(F.col(cells), labels)).select(*(c for c in rows.columns if c != cells), "r.*")


def agreements(rows: DataFrame, cells: str, kind: str = "AC") -> DataFrame:
    """The agreements of landed rows of their kind, with their other columns."""
    return rows.where(_cell(F.col(cells), KIND) == kind).withColumn("a", agreement(F.col(cells))).select(*(c for c in rows.columns if c != cells), "a.*")


def tabular_records(rows: DataFrame, known: DataFrame, labels: dict[str, str], base: str) -> DataFrame:
    """Records of a headed file's rows (ord, NRO, ANIO, TIPO, ORIGEN, CARATULA, MESA, DAE,
    AUTOR, COM1 to COM5) whose number, year and kind aren't known, the first of each.

    Without a year it is 2025, without a kind PL, without an origin S. Rows whose number
    isn't one are left out.
    """
    cell = lambda c: strip(F.coalesce(c, F.lit("")))
    given = lambda c, default: strip(F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.col(c)))
    keyed = rows.withColumns({"number": cell("NRO").try_cast("int"), "year": blank_to(F.col("ANIO"), "2025").try_cast("int"), "kind": given("TIPO", "PL"), "origin": given("ORIGEN", "S")})
    new = first_wins(only_new(keyed.where("number IS NOT NULL"), known, ["number", "year", "kind"]), ["number", "year", "kind"], ["ord"])
    told = new.withColumn("__of", main_authors(cell("CARATULA"), author_list(F.col("AUTOR"))))
    entry = F.concat(found(cell("DAE"), r"^(\d+)"), F.lit("/"), found(cell("DAE"), r"(\d{4})"))
    return told.select(
        "number", "year", "kind", labelled(F.col("kind"), labels).alias("kind_label"), after_colon(cell("CARATULA")).alias("extract"),
        F.col("__of.main").alias("authors"), F.col("__of.others").alias("coauthors"), group_columns(*(f"COM{k}" for k in range(1, 6))).alias("bodies"),
        F.coalesce(found(cell("MESA"), r"(\d{2}/\d{2}/\d{4})"), F.lit("")).alias("date"), F.coalesce(entry, F.lit("")).alias("entry"), "origin",
        record_url(base, F.col("number"), F.col("year"), F.col("origin"), F.col("kind")).alias("url"),
    )
