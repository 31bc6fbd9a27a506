"""Scans of whole pages against the column expressions of the same rules."""

import random
import time

from ledgerloom.functions import html, pages
from ledgerloom.operators import extract
from ledgerloom.sources import listings
from pyspark.sql import functions as F
from test_html import page

ODD = ["", "no", "</table>", "<table>", "<td/><tr/ >", "<TABLE><TR><TD>a</table>b</td>", "<a href='/x?a=1&copy=2&ntilde;' HREF=y>1</A>", "<!-- <td> --><tdx><td\n>  x </td>", "<table summary='a > b'><tr></table", "<p title=\"x > y\">&#128;&bogus;&notit;</p>"]


def some_pages():
    rng = random.Random(11)
    return [page(rng) for _ in range(120)] + ODD


def test_scan_equals_column_expressions(spark):
    df = spark.createDataFrame(list(enumerate(some_pages())), "k int, h string")
    h = F.col("h")
    tags = html.elements(h, ("a", "table", "tr", "td", "th"))
    shown = df.select(
        "k", tags.alias("e"), F.transform(tags, lambda e: html.attribute(e["tag"], "class")).alias("c"), html.hrefs(h).alias("links"), extract.plain_text(h).alias("plain"),
        F.array_join(F.transform(html.texts(h), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))), "").alias("tight"), extract.row_cells(h, "td", "th").alias("cells"), extract.row_cells(extract.largest_table(h), "td").alias("largest"),
    )
    for r, text in zip(sorted(shown.collect()), some_pages(), strict=True):
        found = pages.elements(text, ("a", "table", "tr", "td", "th"))
        assert [tuple(e) for e in r.e] == [tuple(e) for e in found], text
        assert r.c == [pages.attribute(e.tag, "class") for e in found], text
        assert (r.links, r.plain, r.tight) == (pages.hrefs(text), pages.plain_text(text), pages.tight_text(text)), text
        assert (r.cells, r.largest or []) == (pages.row_cells(text, "td", "th"), pages.largest_rows(text)), text


def test_null_pages_and_empty_tables(spark):
    df = spark.createDataFrame([("x", None), ("y", "")], "k string, h string")
    for some in (df, df.where("k = 'x'"), df.limit(0)):
        assert listings.result_rows(some, "k", "h", "b", ("PL",)).count() == listings.order_rows(some, "k", "h", "b").count() == listings.decree_rows(some, "k", "h", "b").count() == listings.bulletin_links(some, "k", "h", "b").count() == 0
    none = df.select(extract.record_page(F.col("h")).alias("p")).select("p.*").distinct().collect()
    assert [(r.authors, r.bodies, r.entry, r.enacted, r.announced) for r in none] == [([], [], "", False, None)]


def test_time_is_in_proportion_to_a_page(spark):
    """Elements were folded in an array that each step copied: a page took the square of its cells."""
    row = "<tr><td><a href=/exp/{0}>{0}/24</a></td><td>PL</td><td>S</td><td>c{0}</td><td></td><td>t{0}</td></tr>"
    text = f"<table>{''.join(row.format(k) for k in range(8000))}</table>"
    df = spark.createDataFrame([(1, text)], "k int, h string")
    start = time.monotonic()
    found = listings.result_rows(df, "k", "h", "b", ("PL",)).agg(F.count("*"), F.sum("number")).first()
    assert tuple(found) == (8000, sum(range(8000)))
    assert time.monotonic() - start < 25
