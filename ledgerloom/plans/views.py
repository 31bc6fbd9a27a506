"""Records, outcomes and meetings as they are shown: joins, badges, tabs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import canonical_code, code_kind, fold, labelled, strip
from ledgerloom.functions.values import found
from ledgerloom.operators.analytics import badges
from ledgerloom.operators.merge import first_wins


def record_code(origin: Column, number: Column, year: Column) -> Column:
    """The canonical code of a record, as outcomes name it."""
    return canonical_code(F.concat(origin, F.lit("-"), number.cast("string"), F.lit("/"), F.right(year.cast("string"), F.lit(2))))


def passed(result: Column) -> Column:
    return F.coalesce(F.upper(strip(result)).startswith("APROBAD"), F.lit(False))


def order_tab(first_code: Column, tabs: dict[str, str], other: str) -> Column:
    """The tab of an order of the day by the type of its first code."""
    return labelled(code_kind(first_code), tabs, F.lit(other))


def outcome_tab(section: Column, result: Column) -> Column:
    """laws, agreements or other; null of what wasn't approved. Motions of preference are approved ones."""
    ok = passed(result)
    return F.when((section == "ley") & ok, "laws").when((section == "acuerdo") & ok, "agreements").when(((section == "decreto_res_com_dec") & ok) | (section == "preferencia"), "other")


def searched(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows any of whose columns holds a text, whatever its case and accents."""
    held = [F.contains(F.lower(fold(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lower(fold(F.lit(needle)))) for c in columns]
    return rows.where(F.greatest(*held) if len(held) > 1 else held[0])


def with_outcomes(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """records (origin, number, year, ...) with preference, enacted, sent and enacted_text:
    of the latest outcome (code, section, result, observations, date, ord) that enacted
    it the law's name, else the date."""
    o = F.coalesce("observations", F.lit(""))
    enacting = (F.col("section") != "preferencia") & passed(F.col("result"))
    text = F.coalesce(found(o, r"(?i)(Ley\s+N[°º.o]*\s*[\d.]*\d)"), "date")
    marked = outcomes.select(canonical_code(F.col("code")).alias("__code"), "section", o.alias("__o"), enacting.alias("__enacted"), F.when(enacting, text).alias("__text"), F.when(enacting, F.struct("date", "ord")).alias("__at"))
    sent = F.contains(F.upper(fold(F.col("__o"))), F.lit("SE COMUNICA A LA H. CAMARA DE DIPUTADOS"))
    keyed = records.withColumn("__code", record_code(F.col("origin"), F.col("number"), F.col("year")))
    flags = {"preference": F.col("section") == "preferencia", "enacted": F.col("__enacted"), "sent": sent}
    return badges(keyed, marked, "__code", flags, {"enacted_text": ("__text", "__at")}).drop("__code")


def with_agreements(records: DataFrame, agreements: DataFrame, columns: list[str], kind: str = "AC") -> DataFrame:
    """records with columns of the agreement of their number and year, nulls for records of
    another kind or without one; of agreements of a key the first by all columns counts."""
    one = first_wins(agreements, ["number", "year"], columns).select(F.col("number").alias("__n"), F.col("year").alias("__y"), *columns)
    return records.join(one, (F.col("kind") == kind) & (F.col("number") == F.col("__n")) & (F.col("year") == F.col("__y")), "left").drop("__n", "__y")


def with_records(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """outcomes with url and extract of the record of their code, nulls without one; of
    records of a code the first by URL counts."""
    keyed = records.select(record_code(F.col("origin"), F.col("number"), F.col("year")).alias("__code"), "url", "extract")
    one = first_wins(keyed, ["__code"], ["url", "extract"])
    return outcomes.join(one.withColumnRenamed("__code", "__c"), canonical_code(F.col("code")) == F.col("__c"), "left").drop("__c")


def three_valued(flag: Column, yes: str, no: str) -> Column:
    """A badge for true, another for false, none for unknown."""
    return F.when(flag, yes).when(~flag, no)


def agenda(meetings: DataFrame, as_of: Column, body: str | None = None, section: str | None = None) -> DataFrame:
    """meetings (bodies, section, date, ...) of a section, any of whose bodies holds a text,
    with past: before as_of."""
    kept = meetings if section is None else meetings.where(F.col("section") == section)
    if body is not None:
        kept = kept.where(F.exists("bodies", lambda b: F.contains(F.upper(fold(b)), F.upper(fold(F.lit(body))))))
    return kept.withColumn("past", F.col("date") < as_of)


def histories(log: DataFrame, keep: list[str]) -> DataFrame:
    """person, part ('designated' or 'replaced') and the kept columns of each change of a log
    (designated, replaced, ...): what happened to each person."""
    parts = F.array(*(F.struct(F.col(p).alias("person"), F.lit(p).alias("part")) for p in ("designated", "replaced")))
    return log.select(*keep, F.inline(parts)).where(F.coalesce(F.col("person"), F.lit("")) != "")
