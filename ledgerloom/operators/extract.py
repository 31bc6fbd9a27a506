"""Rows from HTML, JSON and running text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import pages
from ledgerloom.functions.html import attribute, decoded, elements, every, hrefs, let, named, tag_text, within
from ledgerloom.functions.text import squash, strip
from ledgerloom.functions.values import found, has_surname

# How case codes, their links and agenda items are spelt.
CASE_CODE = r"\b([A-ZÑ.]{1,5}-\d+/\d{2})\b"
AGENDA_CODE = r"\b([A-ZÑ]{1,3}(?:\.[A-ZÑ]{1,2})?-\d+/\d+)\b"
CASE_LINK = r"(?i)/verExp/(\d+)\.(\d+)/([A-Z0-9.]+)/([A-Z0-9]+)"


def plain_text(html: Column) -> Column:
    """HTML without tags, references resolved, white space squashed; null as empty."""
    return squash(decoded(tag_text(html)))


def links(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """id, pos, href of each link, in order."""
    return df.select(id_col, F.posexplode(hrefs(F.col(html))).alias("pos", "href"))


def tables(html: Column) -> Column:
    """The tables of a page, as array of (rows, html), nested ones after the table that
    holds them; a table's rows are also those of tables within it."""
    table = lambda found, t: F.struct(F.size(within(found, t, "tr")).alias("rows"), F.concat(t["tag"], t["inner"], F.lit("</table>")).alias("html"))
    return let(elements(html), lambda found: F.transform(named(found, "table"), lambda t: table(found, t)))


def largest_table(html: Column) -> Column:
    """The table with most rows, the first of equals; null without one."""
    most = lambda t: F.array_max(F.transform(t, lambda x: x["rows"]))
    return let(tables(html), lambda t: F.get(F.filter(t, lambda x: x["rows"] == most(t)), F.lit(0))["html"])


def table_where(found: Column, name: str, wanted) -> Column:
    """Of ``tables`` the first whose attribute of that name is as wanted; null without one."""
    return F.get(F.filter(found, lambda x: F.coalesce(wanted(attribute(x["html"], name)), F.lit(False))), F.lit(0))["html"]


def table_by_summary(html: Column, text: str) -> Column:
    """The first table whose summary holds a text, whatever its case."""
    return let(tables(html), lambda found: with_summary(found, text))


def with_summary(found: Column, text: str) -> Column:
    """The same of ``tables``."""
    return table_where(found, "summary", lambda s: F.contains(F.upper(s), F.lit(text.upper())))


def row_cells(html: Column, *kinds: str) -> Column:
    """array<array<string>>: the HTML of the cells of each row, those of nested tables too."""
    return let(elements(html), lambda found: F.transform(named(found, "tr"), lambda r: F.transform(within(found, r, *kinds), lambda c: c["inner"])))


def cells(table: Column) -> Column:
    """The HTML of the cells of each row, headings too."""
    return row_cells(table, "td", "th")


def table_rows(df: DataFrame, id_col: str, table: Column, least_cells: int) -> DataFrame:
    """id, row_no, cells (plain text), row_cells (HTML) of rows with enough cells."""
    rows = df.select(id_col, F.posexplode(cells(table)).alias("row_no", "row_cells")).where(F.size("row_cells") >= least_cells)
    return rows.withColumn("cells", F.transform("row_cells", plain_text))


def column_at(header: Column, name: str) -> Column:
    """The index of the first header that holds a name, null without one."""
    at = F.array_position(F.transform(header, lambda h: F.contains(F.upper(h), F.lit(name.upper()))), True)
    return F.when(at > 0, at - 1).cast("int")


def case_link(href: Column) -> Column:
    """struct(number, year, origin, kind, url) of a case's link; dots dropped from the origin."""
    part = lambda k: found(href, CASE_LINK, k)
    year = part(2).try_cast("int")
    return F.struct(part(1).try_cast("int").alias("number"), F.when(F.length(part(2)) == 2, year + 2000).otherwise(year).alias("year"), F.replace(part(3), F.lit("."), F.lit("")).alias("origin"), part(4).alias("kind"), href.alias("url"))


def body_rows(table: Column) -> Column:
    """array<array<string>>: the texts of the td cells of each row that has some."""
    return F.filter(F.transform(row_cells(table, "td"), lambda r: F.transform(r, plain_text)), lambda r: F.size(r) > 0)


def three_state(table: Column, header: str) -> Column:
    """struct(known, date) of the first row's cell under the header of that name: null
    without table, header, row or cell, false without a date in it."""

    def of(e: Column) -> Column:
        at = F.array_position(F.transform(named(e, "th"), lambda h: F.upper(plain_text(h["inner"]))), F.lit(header.upper())).cast("int")
        first = F.get(F.filter(F.transform(named(e, "tr"), lambda r: within(e, r, "td")), lambda r: F.size(r) > 0), F.lit(0))
        return let(F.struct(at.alias("at"), first.alias("row")), lambda p: F.when(p["at"] > 0, plain_or_null(F.get(p["row"], p["at"] - 1)["inner"])))

    plain_or_null = lambda h: F.when(h.isNotNull(), plain_text(h))
    return state_of_cell(let(elements(table), of))


def state_of_cell(text: Column) -> Column:
    """The same of the cell's text, null without one."""
    dated = lambda c: F.struct(c.alias("cell"), found(c, r"(\d{2}-\d{2}-\d{4})").alias("date"))
    state = lambda p: F.struct(F.when(p["cell"].isNotNull(), p["date"].isNotNull()).alias("known"), F.translate(p["date"], "-", "/").alias("date"))
    return let(let(text, dated), state)


def bodies_of_page(html: Column) -> Column:
    """Committees of the table of referrals, in order, without their place in the order."""
    return bodies_of(table_by_summary(html, "GIROS DEL EXPEDIENTE"))


def bodies_of(table: Column) -> Column:
    return bodies_of_cells(F.transform(body_rows(table), lambda r: F.get(r, F.lit(0))))


def bodies_of_cells(texts: Column) -> Column:
    """The same of the first cells' texts; null as none."""
    first = F.transform(texts, lambda c: strip(F.regexp_replace(c, r"(?s)ORDEN DE GIRO:.*$", "")))
    return F.coalesce(F.filter(first, lambda x: x != ""), F.array().cast("array<string>"))


def law_of_page(html: Column) -> Column:
    """struct(number, date) of the table of the law that a record became; without a number both are null."""
    return law_of_text(plain_text(table_by_summary(html, "SANCION DE LEY")))


def law_of_text(text: Column) -> Column:
    parts = lambda t: F.struct(found(t, r"NUMERO DE LEY:\s*(\d+)").alias("number"), found(t, r"FECHA DE SANCION:\s*(\d{2}-\d{2}-\d{4})").alias("date"))
    dated = lambda p: F.struct(p["number"].alias("number"), F.when(p["number"].isNotNull(), F.translate(p["date"], "-", "/")).alias("date"))
    return let(let(text, parts), dated)


def authors_of_page(html: Column) -> Column:
    """Names of the persons that a page links to: the link's title, else its text."""
    person = lambda a: F.coalesce(F.contains(attribute(a["tag"], "href"), F.lit("/senadores/senador/")), F.lit(False))
    name = lambda a: let(strip(F.coalesce(attribute(a["tag"], "title"), F.lit(""))), lambda t: F.when(t != "", t).otherwise(plain_text(a["inner"])))
    names = F.transform(F.filter(elements(html, ("a",)), person), name)
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


_RECORD_TEXTS = "text string, authors array<string>, bodies array<string>, law string, desk string"
_RECORD_ARROW = pa.struct([("text", pa.string()), ("authors", pa.list_(pa.string())), ("bodies", pa.list_(pa.string())), ("law", pa.string()), ("desk", pa.string())])


def _record_texts(html: pa.Array) -> pa.Array:
    """Of each page its text, its authors, the first cells of the table of referrals, the text
    of the law's table and that of the cell of the announcement; null without one."""
    return pa.array([_texts_of_record(page or "") for page in pages.texts(html)], _RECORD_ARROW)


def _texts_of_record(page: str) -> dict:
    tables_of = [((pages.attribute(t, "summary") or "").upper(), t) for _, t in pages.tables(page)]
    table = lambda text: next((t for summary, t in tables_of if text in summary), None)
    law, desk, bodies = table("SANCION DE LEY"), table("FECHAS EN MESA DE ENTRADAS"), table("GIROS DEL EXPEDIENTE")
    people = (a for a in pages.elements(page, ("a",)) if "/senadores/senador/" in (pages.attribute(a.tag, "href") or ""))
    names = (pages.strip(pages.attribute(a.tag, "title") or "") or pages.plain_text(a.inner) for a in people)
    return {
        "text": pages.plain_text(page),
        "authors": [n for n in names if n],
        "bodies": [pages.plain_text(r[0]) for r in pages.row_cells(bodies, "td") if r] if bodies else [],
        "law": pages.plain_text(law),
        "desk": _cell_under(desk, "DADO CUENTA") if desk else None,
    }


def _cell_under(table: str, header: str) -> str | None:
    """The text of the first row's cell under a header."""
    found = pages.elements(table)
    at = next((k for k, h in enumerate(pages.named(found, "th")) if pages.plain_text(h.inner).upper() == header), None)
    row = next((r for r in (pages.within(found, r, "td") for r in pages.named(found, "tr")) if r), [])
    return pages.plain_text(row[at].inner) if at is not None and at < len(row) else None


def record_page(html: Column) -> Column:
    """What a record's page says: authors, bodies, entry, archived, archived_on, lapsed,
    lapsed_on, enacted, law, law_date, announced and announced_on. A lapsed record is
    archived too. A null page has no authors and bodies, is none of these, and its
    announcement is unknown."""
    day = lambda text, before: F.translate(found(text, before + r"\s*(\d{2}-\d{2}-\d{4})"), "-", "/")
    entry = lambda text: F.coalesce(found(text, r"D\.A\.E\.\s*(\d+/\d{4})"), found(text, r"(\d+/\d{4})\s*Tipo:"), F.lit(""))
    from_text = lambda t: F.struct(entry(t).alias("entry"), day(t, r"(?i)ENVIADO AL ARCHIVO\s*:").alias("archived"), day(t, r"(?i)EL EXPEDIENTE CADUCO EL").alias("lapsed"))
    # The texts of a page are read once, by one scan in a task.
    read = F.arrow_udf(_record_texts, _RECORD_TEXTS)(html)
    from_tables = lambda r: F.struct(law_of_text(r["law"]).alias("law"), state_of_cell(r["desk"]).alias("desk"), bodies_of_cells(r["bodies"]).alias("bodies"))
    parts = let(read, lambda r: F.struct(let(r["text"], from_text).alias("t"), from_tables(r).alias("k"), r["authors"].alias("authors")))
    given = lambda p: F.struct(
        p["authors"].alias("authors"),
        p["k"]["bodies"].alias("bodies"),
        p["t"]["entry"].alias("entry"),
        (p["t"]["archived"].isNotNull() | p["t"]["lapsed"].isNotNull()).alias("archived"),
        p["t"]["archived"].alias("archived_on"),
        p["t"]["lapsed"].isNotNull().alias("lapsed"),
        p["t"]["lapsed"].alias("lapsed_on"),
        p["k"]["law"]["number"].isNotNull().alias("enacted"),
        p["k"]["law"]["number"].alias("law"),
        p["k"]["law"]["date"].alias("law_date"),
        p["k"]["desk"]["known"].alias("announced"),
        p["k"]["desk"]["date"].alias("announced_on"),
    )
    return let(parts, given)


def column_map(cells: Column) -> Column:
    """struct(date, time, body, room): the place of the first cell that names each column and
    isn't taken by one before it, null without one. A row that has date and time is a header."""
    up = F.transform(cells, lambda c: F.upper(F.coalesce(c, F.lit(""))))
    taken: list[Column] = []
    for pattern in ("FECHA", "HORA", "COMISI", "SAL[ÓO]N"):
        free = F.transform(up, lambda c, i: c.rlike(pattern) & ~F.coalesce(i.isin(*taken) if taken else F.lit(False), F.lit(False)))  # noqa: B023
        taken.append((F.nullif(F.array_position(free, True), F.lit(0)) - 1).cast("int"))
    return F.struct(*(at.alias(name) for at, name in zip(taken, ("date", "time", "body", "room"), strict=True)))


def day_cell(c: Column) -> Column:
    """struct(day, date) of a cell with a weekday and a dd/mm line, empty without them; the last of each counts."""
    lines = multi_line_cell(F.coalesce(c, F.lit("")))
    last = lambda p: F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(p)), F.lit(-1)), F.lit(""))
    return F.struct(F.upper(last(r"(?iu)^(LUNES|MARTES|MI[EÉ]RCOLES|JUEVES|VIERNES|S[AÁ]BADO|DOMINGO)\b")).alias("day"), last(r"^\d{1,2}/\d{2}$").alias("date"))


def body_cell(c: Column) -> Column:
    """struct(bodies, mode): a line in parentheses is the mode, the last one counts; the others are bodies."""
    lines = multi_line_cell(F.coalesce(c, F.lit("")))
    modes = F.filter(lines, lambda x: x.rlike(r"^\(.+\)$"))
    mode = strip(F.regexp_replace(F.coalesce(F.try_element_at(modes, F.lit(-1)), F.lit("")), r"^\(|\)$", ""))
    return F.struct(F.filter(lines, lambda x: ~x.rlike(r"^\(.+\)$")).alias("bodies"), mode.alias("mode"))


def room_cell(c: Column) -> Column:
    """struct(room, full): the first line, and all lines."""
    lines = multi_line_cell(F.coalesce(c, F.lit("")))
    return F.struct(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("room"), F.array_join(lines, " ").alias("full"))


def case_codes(c: Column) -> Column:
    """All case codes, dots dropped."""
    return F.transform(every(c, CASE_CODE), lambda x: F.replace(x, F.lit("."), F.lit("")))


def explode_codes(df: DataFrame, text: str, out: str = "code") -> DataFrame:
    """A row for each code of text; rows without one vanish."""
    return df.withColumn(out, F.explode(case_codes(F.col(text))))


def hyperlink(c: Column) -> Column:
    """struct(url, text) of a HYPERLINK formula, else an empty URL and the text."""
    pattern = r"""(?i)HYPERLINK\(\s*"([^"]*)"\s*,\s*"([^"]*)"\s*\)"""
    is_link = F.coalesce(c.rlike(pattern), F.lit(False))
    return F.struct(F.when(is_link, F.regexp_extract(c, pattern, 1)).otherwise("").alias("url"), F.when(is_link, F.regexp_extract(c, pattern, 2)).otherwise(c).alias("text"))


def group_columns(*columns: str) -> Column:
    """The values of repeated columns as an array, blanks dropped, order kept."""
    return F.filter(F.transform(F.array(*(F.col(c).cast("string") for c in columns)), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def agenda_items(c: Column) -> Column:
    """array<struct<number, extract>> of an agenda that marks its items by EXPTE; one item without a number if it has none."""
    parts = F.filter(F.transform(F.split(squash(c), r"(?i)(?=EXPTE\.)"), squash), lambda p: p.rlike("(?i)EXPTE"))
    mark = r"(?i)EXPTE\.?\s*([A-ZÑ]{1,3}(?:\.[A-ZÑ]{1,2})?-?\s*\d+/\d+)"
    one = lambda p: F.struct(F.upper(F.regexp_replace(F.regexp_extract(p, mark, 1), r"\s+", "")).alias("number"), squash(F.regexp_replace(F.when(p.rlike(mark), F.regexp_replace(p, "^.*?" + mark, "")).otherwise(p), r"^[ ,:.-]+", "")).alias("extract"))
    alone = F.array(F.struct(F.lit("").alias("number"), squash(c).alias("extract")))
    return F.when(squash(c) == "", F.slice(alone, 1, 0)).when(c.rlike("(?i)EXPTE"), F.transform(parts, one)).otherwise(alone)


def free_agenda_items(c: Column) -> Column:
    """The same of an agenda whose codes have no mark: the text up to the next code, without the label of the next group."""
    marked = F.split(F.regexp_replace(squash(c), AGENDA_CODE, "\u0001$1\u0002"), "\u0001")
    trim = lambda x: strip(x, ",:.\\-")
    bare = lambda x: trim(F.regexp_replace(x, r"\s*[A-ZÁÉÍÓÚÑ ,]{6,}:\s*$", ""))
    before = trim(F.get(marked, F.lit(0)))
    items = F.transform(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), lambda p: F.struct(F.upper(F.get(F.split(p, "\u0002"), F.lit(0))).alias("number"), bare(F.get(F.split(p, "\u0002"), F.lit(1))).alias("extract")))
    first = F.array(F.struct(F.lit("").alias("number"), F.when(F.size(marked) > 1, before).otherwise(squash(c)).alias("extract")))
    keeps = (before != "") & ((F.size(marked) == 1) | ~before.rlike(r"^[A-ZÁÉÍÓÚÑ ,]+$"))
    return F.when(keeps, F.concat(first, items)).otherwise(items)


def decree_changes(text: Column) -> Column:
    """array<struct<body, designated, replaced>> of a decree's articles that designate members of a body."""
    marked = F.split(F.regexp_replace(text, r"(?i)(Art[íi]culo\s+\d+)", "\u0001$1"), "\u0001")
    articles = F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0)))
    wanted = F.filter(articles, lambda a: F.contains(a, F.lit("Comisi")) & a.rlike(r"(?i)Des[íi]gn") & a.rlike(r"(?is)en\s+la\s+Comisi[óo]n\s+de\s+"))
    body = lambda a: squash(F.regexp_extract(a, r"(?is)en\s+la\s+Comisi[óo]n\s+de\s+(.+?)(?:,|\.|$)", 1))
    new = lambda a: F.regexp_extract(a, r"(?is)Des[íi]gn[ae]?s?e?\s+(.*?)en\s+la\s+Comisi[óo]n", 1)
    apart = lambda a: F.regexp_replace(a, r"(?i)(en\s+reemplazo\s+de)l\b", "$1 el")
    until = lambda end: r"(?is)en\s+reemplazo\s+de\s+(.*?)" + end
    old = lambda a: F.coalesce(found(apart(a), until(r",?\s*respectivamente")), F.regexp_extract(apart(a), until(r"(?:\.|$)"), 1))
    changes = F.transform(wanted, lambda a: F.struct(body(a).alias("body"), person_names(new(a)).alias("designated"), person_names(old(a)).alias("replaced")))
    return F.filter(changes, lambda x: F.size(x["designated"]) > 0)


def person_names(c: Column) -> Column:
    """Names of a list in prose, without forms of address; a name has a word in upper case."""
    bare = F.regexp_replace(c, r"(?iU)\b(?:al|a\s+las?|a\s+los|el|los|las?)\s+señor(?:es|as|a)?\s+Senador(?:es|as|a)?\b", " ")
    parts = F.transform(F.split(bare, r"(?iU)\s+y\s+|,\s*"), lambda p: squash(strip(p, ".;")))
    return F.filter(parts, lambda p: (p != "") & has_surname(p))


def lenient_json(c: Column, schema: str | T.DataType) -> Column:
    """from_json of a text that may have commas before closing brackets."""
    return F.from_json(F.regexp_replace(c, r",\s*([}\]])", "$1"), schema)


def dispatch(df: DataFrame, text: str, marks: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text holds both marks, and the others."""
    has = F.coalesce(F.contains(F.col(text), F.lit(marks[0])) & F.contains(F.col(text), F.lit(marks[1])), F.lit(False))
    return df.where(has), df.where(~has)


def multi_line_cell(c: Column) -> Column:
    """Non-blank lines of a cell."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), squash), lambda x: x != "")


def room_and_mode(c: Column) -> Column:
    """struct(room, mode): the mode stands in parentheses."""
    return F.struct(squash(F.regexp_replace(c, r"\([^)]*\)", "")).alias("room"), F.coalesce(found(c, r"\(([^)]*)\)"), F.lit("")).alias("mode"))
