"""Numbers, dates, times and flags from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold, strip

# Names of months.
MONTHS = ("ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def year_by_length(c: Column) -> Column:
    """Two digits mean this century, others stay."""
    return F.when(F.length(c) == 2, c.try_cast("int") + 2000).otherwise(c.try_cast("int"))


def year_always(c: Column) -> Column:
    """2000 is added whatever the length."""
    return c.try_cast("int") + 2000


def year_by_size(c: Column) -> Column:
    """Under 100 means this century."""
    n = c.try_cast("int")
    return F.when(n < 100, n + 2000).otherwise(n)


def slashed_date(c: Column) -> Column:
    """The first dd-mm-yyyy anywhere, as dd/mm/yyyy; null without one."""
    return F.translate(found(c, r"(\d{2}-\d{2}-\d{4})"), "-", "/")


def date_or_null(c: Column) -> Column:
    """A text that is dd/mm/yyyy as a whole, valid in the calendar or not."""
    return F.when(strip(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), strip(c))


def as_date(c: Column) -> Column:
    return F.try_to_date(c, "dd/MM/yyyy")


def law_and_date(c: Column) -> Column:
    """struct(number, date) of 'number - dd/mm/yyyy', both null otherwise."""
    pattern = r"^(\d+)\s*-\s*(\d{2}/\d{2}/\d{4})$"
    return F.struct(found(strip(c), pattern).alias("number"), found(strip(c), pattern, 2).alias("date"))


def order_number(c: Column, typed: Column | None = None) -> Column:
    """struct(number, year, kind) of '275/2026 (N)'. typed: a timestamp that a
    spreadsheet made of '5/2026', used where it isn't null."""
    text = F.coalesce(strip(c), F.lit(""))
    bare = strip(F.regexp_replace(F.regexp_replace(text, r"(?i)\s*\([AN]\)\s*", ""), r"(?i)\s+y\s+anexo.*$", ""))
    number, year = found(bare, r"^(\d+)\s*/\s*(\d+)$").try_cast("int"), year_by_size(found(bare, r"^(\d+)\s*/\s*(\d+)$", 2))
    kind = F.when(F.contains(F.upper(text), F.lit("(A)")), "ANEXO").otherwise("NORMAL")
    if typed is None:
        return F.struct(number.alias("number"), year.alias("year"), kind.alias("kind"))
    return F.when(typed.isNotNull(), F.struct(F.month(typed).alias("number"), F.year(typed).alias("year"), F.lit("NORMAL").alias("kind"))).otherwise(F.struct(number.alias("number"), year.alias("year"), kind.alias("kind")))


def leading_int(c: Column) -> Column:
    """The integer at the start; null for S/T and the like."""
    return found(strip(c), r"^(\d+)").try_cast("int")


def bulletin_number(c: Column, within: int = 200) -> Column:
    """A bulletin's number if it stands among the first characters."""
    return found(F.substring(c, 1, within), r"(?iu)N[°ºo.]*\s*(\d+(?:/\d+)?)")


def clock(c: Column) -> Column:
    """HH:MM without a final H; what follows another item is 'A continuación'; else as it is."""
    text = F.upper(strip(F.regexp_replace(strip(c), r"(?i)\s*H$", "")))
    return F.when(F.contains(text, F.lit("CONTINUACI")), "A continuación").otherwise(F.coalesce(found(text, r"^(\d{1,2}:\d{2})"), text))


def month_number(c: Column) -> Column:
    """Two digits of a month's name, empty if unknown."""
    pairs = [F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, f"{k:02d}")]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(fold(c))), F.lit(""))


def truthy(c: Column, kind: str) -> Column:
    """Whether a value counts as given: not null, empty, zero or false. kind: its type."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind in ("date", "timestamp", "timestamp_ntz", "binary") or kind.startswith("struct"):
        return c.isNotNull()
    return F.coalesce(c != 0, F.lit(False))


def approved(order_part: Column, outcome_part: Column, mark: str = "AP") -> Column:
    return F.coalesce(F.contains(order_part, F.lit(mark)) & F.contains(outcome_part, F.lit(mark)), F.lit(False))


def status_flags(archived: Column, lapsed: Column, law: Column) -> Column:
    """archived and lapsed, each by its own date, and enacted, by a law's number."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return F.struct(given(archived).alias("archived"), given(lapsed).alias("lapsed"), given(law).alias("enacted"))


def meeting_kind(section: Column, bodies: Column) -> Column:
    """bicameral if any body is, else the section."""
    return F.when(F.exists(bodies, lambda b: F.contains(F.upper(b), F.lit("BICAMERAL"))), "bicameral").otherwise(section)


def has_surname(c: Column) -> Column:
    """Whether a word is letters in upper case only."""
    return F.exists(F.split(fold(c), r"(?U)\s+"), lambda w: w.rlike(r"^\p{Lu}+$"))
