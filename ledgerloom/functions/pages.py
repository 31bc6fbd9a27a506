"""Whole pages in tasks: the rules of ``html`` on Python texts, for operators over pages.

A page is scanned once from its start. Column expressions, which are interpreted item by
item and copy what an element step has found, stay for what needs no scan of a page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from html import unescape
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions.html import _BARE, _HIDDEN, TABLE_TAGS

#: ``html``'s rest of a tag, with fewer choices on its way.
_END = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_EDGES = re.compile(rf"^{_SPACE.pattern}|{_SPACE.pattern}\Z")
_TAG = re.compile(f"(?as)</?[A-Za-z!?]{_END}")
_LINK = re.compile(rf"(?ais)<a\b{_END}")
_HID = re.compile(_HIDDEN.replace("(?is)", "(?ais)"))
_IN_ATTRIBUTE = re.compile(rf"&\#[0-9]+;?|&\#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:{_BARE})(?![A-Za-z0-9=])")


class Element(NamedTuple):
    """As an item of ``html.elements``: those within it are from rank + 1 to before next."""

    rank: int
    next: int
    name: str
    tag: str
    inner: str


def content(page: str) -> str:
    return _HID.sub("", page) if "<" in page else page


def squash(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def strip(text: str) -> str:
    return _EDGES.sub("", text)


def plain_text(page: str | None) -> str:
    return squash(unescape(_TAG.sub(" ", content(page)))) if page else ""


def tight_text(page: str) -> str:
    return "".join(squash(unescape(x)) for x in _TAG.split(content(page)))


@cache
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"""(?ais)<[a-z0-9]+(?:[^>"']|"[^"]*"|'[^']*')*?(?<=[\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""")


def attribute(tag: str, name: str) -> str | None:
    found = _attribute(name).match(tag)
    if not found:
        return None
    value = found[1][1:-1] if found[1][0] in "\"'" else found[1]
    return _IN_ATTRIBUTE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), value) if "&" in value else value


def hrefs(page: str) -> list[str]:
    found = (attribute(a, "href") for a in _LINK.findall(content(page)))
    return [h for h in found if h is not None]


@cache
def _tags(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?ais)</?({'|'.join(names)})\b{_END}")


def elements(page: str, names: tuple[str, ...] = TABLE_TAGS) -> list[Element]:
    page = content(page)
    #: rank, name, tag and where its content begins of what is open; of each rank its element.
    opened: list[tuple[int, str, str, int]] = []
    done: list[Element | None] = []
    for t in _tags(names).finditer(page):
        name, tag = t[1].lower(), t[0]
        if tag[1] == "/":
            if (opened and opened[-1][1] == name) or any(o[1] == name for o in opened):
                closed = ""
                while closed != name:
                    rank, closed, own, start = opened.pop()
                    done[rank] = Element(rank, len(done), closed, own, page[start : t.start()])
        elif "/" in tag and tag[:-1].rstrip("\t\n\v\f\r ").endswith("/"):
            done.append(Element(len(done), len(done) + 1, name, tag, ""))
        else:
            opened.append((len(done), name, tag, t.end()))
            done.append(None)
    for rank, name, own, start in opened:
        done[rank] = Element(rank, len(done), name, own, page[start:])
    return done


def named(found: list[Element], name: str) -> list[Element]:
    return [x for x in found if x.name == name]


def within(found: list[Element], e: Element, *names: str) -> list[Element]:
    return [x for x in found[e.rank + 1 : e.next] if x.name in names]


def tables(page: str) -> list[tuple[int, str]]:
    """Rows and HTML of each table."""
    found = elements(page)
    return [(len(within(found, t, "tr")), f"{t.tag}{t.inner}</table>") for t in found if t.name == "table"]


def row_cells(page: str, *kinds: str) -> list[list[str]]:
    found = elements(page)
    return [[c.inner for c in within(found, r, *kinds)] for r in found if r.name == "tr"]


def largest_rows(page: str) -> list[list[str]]:
    """The td cells of each row of the table with most rows, the first of equals; no rows without one."""
    found = elements(page)
    sizes = [(len(within(found, t, "tr")), t) for t in found if t.name == "table"]
    if not sizes:
        return []
    table = max(sizes, key=lambda s: s[0])[1]
    return [[c.inner for c in within(found, r, "td")] for r in within(found, table, "tr")]


def texts(column: pa.Array) -> list[str | None]:
    """Python texts; what isn't UTF-8 is replaced."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def rows_of(df: DataFrame, by: str, html: str, read: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """by and columns (names and types) of each row that read finds in a page; nulls have none."""
    schema = T.StructType([df.schema[by], *T.StructType.fromDDL(columns)])
    names, types = schema.names, to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, rows = [], []
            for k, page in enumerate(texts(batch.column(1))):
                if page is not None:
                    found = read(page)
                    rows += found
                    whose += [k] * len(found)
            found = list(zip(*rows, strict=True)) or [()] * (len(types) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(found, types[1:], strict=True))], names)

    return df.select(by, html).mapInArrow(run, schema)
