"""Orders of the day: landed sheet rows as records, enriched by the sheets of a second workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to, code_kind, code_origin, extract_parts, labelled, referrals, sentence_case, signers, strip, title_particles
from ledgerloom.functions.values import order_number
from ledgerloom.operators.analytics import numeric_or_zero
from ledgerloom.operators.merge import last_wins

# The sheets that enrich orders, in the order in which later ones win, and whether they name a leading committee.
SHEETS = {"OD LEY": True, "ANEXO I": True, "OD ACUERDOS": False}


def case_parts(c: Column) -> Column:
    """Codes of a cell, apart by line breaks or spaced hyphens."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n| - "), lambda x: strip(x)), lambda x: x != "")


def day_orders(rows: DataFrame, origins: dict[str, str], categories: dict[str, str], only: str | None = None) -> DataFrame:
    """Orders of landed rows (ord, period, number, kind, codes, codes_url, extract, bodies, date, file_url).

    Rows without a period or number don't count; only: the type that an order's first
    code must have. The link of the codes' cell belongs to the first code. A number that
    a sheet keeps as 12.0 is 12. An order without an author has a null one.
    """
    keyed = rows.where(F.col("period").isNotNull() & F.col("number").isNotNull()).withColumn("codes", case_parts(F.col("codes")))
    first = F.get(F.col("codes"), F.lit(0))
    kept = keyed if only is None else keyed.where(code_kind(first) == only)
    said = kept.withColumn("__said", extract_parts(strip(F.coalesce("extract", F.lit("")))))
    author = F.nullif(F.col("__said.author"), F.lit(""))
    return said.select(
        "ord",
        F.regexp_replace(strip(F.col("number").cast("string")), r"^(\d+)\.\d+$", "$1").alias("number"),
        F.col("period").try_cast("double").try_cast("int").alias("period"),
        F.when(F.upper(strip(F.coalesce("kind", F.lit("")))).startswith("ANEXO"), "ANEXO").otherwise("NORMAL").alias("kind"),
        F.coalesce(code_origin(first, origins), F.lit("")).alias("origin"),
        labelled(code_kind(first), categories, F.lit("")).alias("category"),
        F.when(author.isNotNull(), title_particles(author)).alias("author"),
        sentence_case(F.col("__said.description")).alias("description"),
        F.transform("codes", lambda c, i: F.struct(c.alias("code"), F.when(i == 0, F.col("codes_url")).alias("url"))).alias("cases"),
        referrals(F.col("bodies")).alias("bodies"),
        "date",
        "file_url",
    )


def enrichments(cells: DataFrame, sheets: dict[str, bool] = SHEETS, first_row: int = 4) -> DataFrame:
    """number, period, kind, signers, lead of landed rows (sheet, row, order, typed, signers, lead).

    Rows of other sheets, above first_row or without a readable order don't count. An
    order 'y ANEXO' gives its signers up to 'ANEXO:' to the order and the others, if
    there are any, to its annex. Of a key the last row of the last sheet wins.
    """
    names = [F.lit(x) for at, name in enumerate(sheets) for x in (name, at)]
    rank = F.try_element_at(F.create_map(*names), F.col("sheet"))
    known = cells.withColumn("__rank", rank).where(rank.isNotNull() & (F.col("row") >= first_row) & (F.col("typed").isNotNull() | blank_to(F.col("order"), None).isNotNull()))
    halves = F.split(F.coalesce("signers", F.lit("")), "ANEXO:", 2)
    rest = strip(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    one = lambda kind, names: F.struct(kind.alias("kind"), signers(names).alias("signers"))
    own = F.array(one(F.lit("NORMAL"), F.get(halves, F.lit(0))))
    both = F.col("typed").isNull() & F.contains(F.lower("order"), F.lit("y anexo"))
    split = F.when(rest != "", F.concat(own, F.array(one(F.lit("ANEXO"), rest)))).otherwise(own)
    numbered = known.withColumn("__n", order_number(F.col("order"), F.col("typed"))).where(F.col("__n.number").isNotNull())
    entries = numbered.withColumn("__e", F.explode(F.when(both, split).otherwise(F.array(one(F.col("__n.kind"), F.col("signers"))))))
    named = F.col("sheet").isin(*(s for s, has in sheets.items() if has))
    listed = entries.select("__rank", "row", F.col("__n.number").alias("number"), F.col("__n.year").alias("period"), F.col("__e.kind").alias("kind"), F.col("__e.signers").alias("signers"), F.when(named, F.col("lead")).alias("lead"))
    return last_wins(listed, ["number", "period", "kind"], ["__rank", "row"]).drop("__rank", "row")


def enriched(orders: DataFrame, more: DataFrame, agreement: str, agreements_body: str) -> DataFrame:
    """orders with signers (null without any) and lead, the leading committee; that of an
    agreement without one is agreements_body. Orders whose number isn't one match nothing."""
    found = more.select(F.col("number").alias("__n"), F.col("period").alias("__p"), F.col("kind").alias("__k"), F.col("signers").alias("__s"), F.nullif("lead", F.lit("")).alias("__l"))
    same = (F.col("number").try_cast("int") == F.col("__n")) & (F.col("period") == F.col("__p")) & (F.col("kind") == F.col("__k"))
    joined = orders.join(found, same, "left")
    values = {"signers": F.when(F.size("__s") > 0, F.col("__s")), "lead": F.coalesce("__l", F.when(F.col("category") == agreement, agreements_body))}
    return joined.withColumns(values).drop("__n", "__p", "__k", "__s", "__l")


def latest_first(orders: DataFrame) -> DataFrame:
    """The latest periods and largest numbers first, others as 0, ties in landed order."""
    return orders.orderBy(F.desc("period"), numeric_or_zero(F.col("number")).desc(), "ord")
