"""HTML expressions against the standard library's parser and ``html.unescape``."""

import html as std
import random
from html.parser import HTMLParser

from ledgerloom.functions import html
from pyspark.sql import functions as F

TAGS = ("table", "tr", "td", "th")


class Tree(HTMLParser):
    """Start tags of TAGS with their texts, as a lenient parser nests them."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.hidden = [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in TAGS:
            self.found.append([tag, dict(reversed(attrs)), "", [x[0] for x in self.open]])
            self.open.append(self.found[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in TAGS and tag in [x[0] for x in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            for x in self.open:
                x[2] += data


def page(rng, depth=0):
    ref = ["&oacute;", "&#243;", "&#xF3;", "&amp;", "&lt;", "&nbsp;", "&copy x", "a & b", "&bogus;", "&#128;", "&hellip;"]
    parts = []
    for _ in range(rng.randint(0, 3)):
        rows = []
        for _ in range(rng.randint(0, 3)):
            cells = [f"<{(t := rng.choice(['td', 'th', 'TD']))} class={rng.choice(['a', chr(39) + 'x > y' + chr(39), chr(34) + 'q&amp;r' + chr(34)])}>{rng.choice(ref)} {page(rng, depth + 1) if depth < 2 and rng.random() < 0.3 else 'v'}{rng.choice([f'</{t}>', f'</{t}>', ''])}" for _ in range(rng.randint(0, 4))]
            rows.append(f"<tr>{''.join(cells)}{rng.choice(['</tr>', '</tr>', ''])}")
        parts.append(f"{rng.choice(['', '<!-- <table> -->', '<script>x = 1;</script>', '</td>', '<td/>'])}<table summary='s&eacute;'>{''.join(rows)}{rng.choice(['</table>', '</TABLE >'])}")
    return "".join(parts)


def test_elements_nest_as_a_lenient_parser_does(spark):
    rng = random.Random(6)
    pages = [page(rng) for _ in range(150)] + ["", "</table>", "<table>", "no"]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, h string")
    found = df.select("k", F.transform(html.elements(F.col("h")), lambda e: F.struct(e["name"], html.attribute(e["tag"], "class").alias("class"), F.array_join(html.texts(e["inner"]), "").alias("text"))).alias("e")).collect()
    for r in found:
        want = [(tag, attrs.get("class"), text) for tag, attrs, text, _ in Tree(pages[r.k]).found]
        assert [tuple(e) for e in r.e] == want, pages[r.k]


def test_what_lies_within_an_element(spark):
    pages = ["<table><tr><td>1<table><tr><td>2</td></tr></table></td><td>3</td></tr><tr><td>4</td></tr></table>"]
    e = html.elements(F.col("h"))
    rows = html.let(e, lambda e: F.transform(html.named(e, "tr"), lambda r: F.size(html.within(e, r, "td"))))
    assert spark.createDataFrame([(p,) for p in pages], "h string").select(rows.alias("n")).first().n == [3, 1, 1]


def test_references_equal_unescape(spark):
    rng = random.Random(7)
    some = ["&", "#", "x", ";", "1", "243", "F3", "amp", "oacute", "copy", "notit", "lt", "bogus", "128512", "99999999999", "0", "xD800", " ", "=", "é", "NotEqualTilde"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(600)] + [None, "&" * 50, "&oacute;" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", html.decoded(F.col("t")).alias("d")).collect():
        assert r.d == (None if texts[r.k] is None else std.unescape(texts[r.k])), texts[r.k]


def test_attributes_of_any_kind(spark):
    tags = {"<a href=/x/13>": "/x/13", "<A HREF = 'a&amp;b'>": "a&b", '<a title="href=no" href="y">': "y", "<a data-href=no>": None, "<a href>": None, "<a href=''>": "", "<a href='/v?a=1&copy=2&lt;'>": "/v?a=1&copy=2<", "<a title='a > b'\nhref=z >": "z"}
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert {r.t: r.h for r in df.select("t", html.attribute(F.col("t"), "href").alias("h")).collect()} == tags
