"""Listings as landed pages and rows: what they offer for reading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import pages
from ledgerloom.functions.html import let
from ledgerloom.functions.text import fold, strip
from ledgerloom.functions.values import found
from ledgerloom.operators.extract import case_link

# Fixed value: how links to bulletins are spelt.
BULLETIN = r"descargarBoletinReunion/(\d+)"


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def under(href: Column, base: str) -> Column:
    """A path from the root gets the base before it; others stay."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def bulletin_links(df: DataFrame, by: str, html: str, base: str) -> DataFrame:
    """by, id, number, url of each link to a bulletin, largest ids first. The number is the
    first cell of the link's table row, empty outside of one."""
    wanted = f"(?i){BULLETIN}"

    def listed(page: str) -> list[tuple]:
        """Links with the first cell of the innermost row around each."""
        out, rows, e = [], [], pages.elements(page, ("table", "tr", "td", "th", "a"))
        for x in e:
            while rows and rows[-1].next <= x.rank:
                rows.pop()
            if x.name == "tr":
                rows.append(x)
            elif x.name == "a" and re.search(f"(?a){wanted}", href := pages.attribute(x.tag, "href") or ""):
                first = next((c.inner for c in e[rows[-1].rank + 1 : rows[-1].next] if c.name == "td"), "") if rows else ""
                out.append((href, pages.tight_text(first)))
        return out

    found = pages.rows_of(df, by, html, listed, "__href string, number string")
    number = F.regexp_extract("__href", wanted, 1).try_cast("long")
    return found.select(by, number.alias("id"), "number", absolute(F.col("__href"), base).alias("url")).orderBy(F.desc("id"), by)


def decree_rows(df: DataFrame, by: str, html: str, base: str) -> DataFrame:
    """by, row_no, number, date, topic, url of the rows of a page's largest table that have
    five cells, a number and a link in the fifth."""
    tight = pages.tight_text
    read = lambda page: [(k, tight(c[3]), tight(c[0]), pages.plain_text(c[1]), next(iter(pages.hrefs(c[4])), None)) for k, c in enumerate(pages.largest_rows(page)) if len(c) >= 5]
    rows = pages.rows_of(df, by, html, read, "row_no int, number string, date string, topic string, __href string")
    return rows.where("number <> '' AND __href IS NOT NULL").select(by, "row_no", "number", "date", "topic", absolute(F.col("__href"), base).alias("url"))


def result_rows(df: DataFrame, by: str, html: str, base: str, kinds: tuple[str, ...]) -> DataFrame:
    """by, row_no, number, year, kind, origin, date, extract, url, title of a search's results:
    rows of a page's largest table with six cells, a link and number/year in the first
    and one of the kinds in the second. A year of two digits is one after 2000; the
    extract is what follows the title's first colon, if it has one."""
    tight = pages.tight_text
    read = lambda page: [(k, tight(c[0]), tight(c[1]), tight(c[2]), tight(c[4]), tight(c[5]), next(iter(pages.hrefs(c[0])), None)) for k, c in enumerate(pages.largest_rows(page)) if len(c) >= 6]
    listed = pages.rows_of(df, by, html, read, "row_no int, __code string, kind string, origin string, date string, title string, __href string")
    part = lambda k: F.regexp_extract("__code", r"^(\d+)/(\d+)", k)
    extract = F.when(F.contains("title", F.lit(":")), strip(F.regexp_replace("title", r"(?s)^[^:]*:", ""))).otherwise(F.col("title"))
    rows = listed.where(F.col("kind").isin(*kinds) & F.col("__href").isNotNull()).select(
        by, "row_no", part(1).try_cast("long").alias("number"), F.when(F.length(part(2)) == 2, F.concat(F.lit("20"), part(2))).otherwise(part(2)).try_cast("int").alias("year"),
        "kind", "origin", "date", extract.alias("extract"), absolute(F.col("__href"), base).alias("url"), "title",
    )
    return rows.where(F.col("number").isNotNull())


def order_rows(df: DataFrame, by: str, html: str, base: str) -> DataFrame:
    """by, row_no, number, year, kind ('N' if none is given), cases, url of the orders of the
    day that a page lists: rows of four cells in the body of its first bordered table whose
    first has number/year. cases: struct<number, year, kind, origin, url> of each case link
    of the second cell, in order; url: the first link of the fourth, empty without one."""

    def read(page: str) -> list[tuple]:
        bordered = next((t for _, t in pages.tables(page) if re.search(r"(?a)(?:^|\s)table-bordered(?:\s|$)", pages.attribute(t, "class") or "")), "")
        body = next((e.inner for e in pages.elements(bordered, ("table", "tbody", "tr", "td", "th")) if e.name == "tbody"), "")
        return [(k, pages.plain_text(c[0]), pages.hrefs(c[1]), next(iter(pages.hrefs(c[3])), None)) for k, c in enumerate(pages.row_cells(body, "td")) if len(c) >= 4]

    listed = pages.rows_of(df, by, html, read, "row_no int, __code string, __cases array<string>, __href string")
    code = F.col("__code")
    case = lambda h: let(case_link(h), lambda c: F.struct(c["number"].alias("number"), c["year"].alias("year"), c["kind"].alias("kind"), c["origin"].alias("origin"), under(h, base).alias("url")))
    cases = F.filter(F.transform("__cases", case), lambda c: c["number"].isNotNull())
    part = lambda k: found(code, r"(\d+)\s*/\s*(\d+)", k).try_cast("int")
    kind = F.coalesce(found(code, r"\((N|A)\)"), F.lit("N"))
    url = F.coalesce(under(F.col("__href"), base), F.lit(""))
    return listed.select(by, "row_no", part(1).alias("number"), part(2).alias("year"), kind.alias("kind"), cases.alias("cases"), url.alias("url")).where(F.col("number").isNotNull())


def session_bulletins(rows: DataFrame, least_year: int) -> DataFrame:
    """rows (number, date, url) with a number and URL whose year isn't before least_year;
    an unreadable year stays. The first hyphen of a number becomes a slash."""
    clean = rows.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("number", "date", "url")}).where("number <> '' AND url <> ''")
    year = strip(F.get(F.split("date", "-"), F.lit(0))).try_cast("int")
    return clean.where(F.coalesce(year >= least_year, F.lit(True))).withColumn("number", F.regexp_replace("number", "^([^-]*)-", "$1/"))


def about(rows: DataFrame, topic: str, word: str) -> DataFrame:
    """Rows whose topic holds a word, whatever its case and accents."""
    return rows.where(F.contains(F.upper(fold(F.col(topic))), F.upper(fold(F.lit(word)))))


def text_status(text: Column, least: int = 40, status: str = "sin_texto") -> Column:
    """status of a text under a length, null of others; a null text is empty."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) < least, status)


def in_window(rows: DataFrame, at: str, as_of: Column, days: int, since: str | None = None) -> DataFrame:
    """Rows of the last days up to as_of, or since a fixed dd/mm/yyyy; if that isn't a date, none."""
    start = F.date_sub(as_of, days) if since is None else F.try_to_date(F.lit(since), "dd/MM/yyyy")
    return rows.where(F.col(at).between(start, as_of))
