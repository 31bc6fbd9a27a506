"""A Python data source for paged searches behind a form: ``spark.read.format("paged_search")``.

As a stream it gives the pages that the searches list, each once, in the order of their ids.
"""

from __future__ import annotations

import html as entities
import json
import os
import re
import time
from collections.abc import Iterator
from http.cookiejar import CookieJar
from urllib.parse import urlencode, urljoin
from urllib.request import HTTPCookieProcessor, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "search string, page int, html string, error string"
ITEM_SCHEMA = "id long, url string, html string"


class Search(InputPartition):
    """A name and the form's fields."""

    def __init__(self, name: str, fields: dict[str, str]):
        super().__init__(name)
        self.name, self.fields = name, fields


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.url, self.start, self.token, self.rows = get("url"), get("start"), get("token"), get("rows")
        self.searches = json.loads(get("searches", "{}"))
        self.pause, self.attempts, self.retry, self.timeout = float(get("pause", "0")), int(get("attempts", "1")), float(get("retry", "20")), float(get("timeout", "30"))
        self.linked, self.first_only, self.keep = get("paging", "links") == "links", get("firstpageonly", "false") == "true", get("errors", "fail") == "keep"
        if not self.url:
            raise ValueError("paged_search needs the option url")
        if not self.linked and not self.rows:
            raise ValueError("paging by rows needs the option rows")

    def partitions(self) -> list[Search]:
        return [Search(k, v) for k, v in self.searches.items()]

    def _open(self, opener, url: str, fields: dict[str, str] | None = None) -> str:
        with opener.open(Request(url, urlencode(fields).encode() if fields is not None else None), timeout=self.timeout) as got:
            return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")

    def _first(self, fields: dict[str, str]) -> tuple[object, str]:
        """A session and the first page of a search in it."""
        opener = build_opener(HTTPCookieProcessor(CookieJar()))
        began = self._open(opener, self.start) if self.start else ""
        if self.token:
            tag = next((t for t in re.findall(r"(?is)<input\b[^>]*>", began) if _attribute(t, "name") == self.token), None)
            if tag is None:
                raise ValueError(f"no field {self.token} in {self.start}")
            fields = {**fields, self.token: _attribute(tag, "value") or ""}
        return opener, self._open(opener, self.url, fields)

    def _listed(self, page: str) -> bool:
        return not self.rows or re.search(self.rows, page) is not None

    def _begun(self, fields: dict[str, str]) -> tuple[object, str]:
        """The first attempt whose page lists something; else the last, as it is."""
        for attempt in range(1, self.attempts + 1):
            try:
                opener, page = self._first(fields)
                if self._listed(page) or attempt == self.attempts:
                    return opener, page
            except OSError:
                if attempt == self.attempts:
                    raise
            time.sleep(self.retry)
        raise ValueError("attempts is below one")

    def _pages(self, search: Search) -> Iterator[tuple]:
        """Pages until one fails to list anything or the next isn't linked; a page equal to the one before ends it too."""
        number, before = 1, None
        opener, page = self._begun(search.fields)
        while page != before and (self.linked or self._listed(page)):
            yield search.name, number, page, None
            number += 1
            after = self._next(page, number)
            if self.first_only or after is None:
                return
            time.sleep(self.pause)
            before, page = page, self._open(opener, after)

    def _next(self, page: str, number: int) -> str | None:
        if not self.linked:
            return f"{self.url}{'&' if '?' in self.url else '?'}page={number}"
        links = (_attribute(a, "href") or "" for a in re.findall(r"(?is)<a\b[^>]*>", page))
        return next((urljoin(self.url, link) for link in links if re.search(rf"[?&]page={number}(?!\d)", link)), None)

    def read(self, partition: Search | None) -> Iterator[tuple]:
        # Without any search Spark reads one partition that is none.
        if partition is None:
            return
        done = 0
        try:
            for row in self._pages(partition):
                done = row[1]
                yield row
        except (OSError, ValueError) as e:
            if not self.keep:
                raise
            yield partition.name, done + 1, None, f"{type(e).__name__}: {e}"


def _attribute(tag: str, name: str) -> str | None:
    found = re.search(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag)
    return entities.unescape(next(g for g in found.groups() if g is not None)) if found else None


class Item(InputPartition):
    """A listed page."""

    def __init__(self, number: int, url: str):
        super().__init__(number)
        self.number, self.url = number, url


class _StreamReader(DataSourceStreamReader):
    """Offsets are a watermark, ``after``, and the ids above it that are done with their
    addresses. The watermark passes an id only in the batch after its own, so that the ids
    of a batch are those of its end that its start doesn't cover, without another listing.
    """

    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.search, self.item, self.state = _Reader(options), get("item"), get("state")
        self.after, self.per_batch = int(get("after", "0")), int(get("perbatch", "1000"))
        if not self.state:
            raise ValueError("a stream of paged_search needs the option state")
        if re.compile(self.item).groups != 1:
            raise ValueError("the pattern item needs one group, the id")
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"after": self.after, "done": {}}

    def _listed(self) -> dict[int, str]:
        """Addresses by id: the smallest of an id that is listed twice."""
        found: dict[int, str] = {}
        searches = self.search.partitions()
        pages = (row[2] for s in searches for row in self.search._pages(s)) if searches else [self.search._open(build_opener(), self.search.url)]
        for page in pages:
            for tag in re.findall(r"(?is)<a\b[^>]*>", page):
                href = _attribute(tag, "href") or ""
                at = re.search(self.item, href)
                if at:
                    url, number = urljoin(self.search.url, href), int(at.group(1))
                    found[number] = min(url, found.get(number, url))
        return found

    def _answers(self, url: str) -> bool:
        try:
            with build_opener().open(Request(url), timeout=self.search.timeout):
                return True
        except OSError:
            return False

    def _remembered(self) -> dict:
        if self.known is None:
            try:
                with open(self.state, encoding="utf-8") as f:
                    self.known = json.load(f)
            except FileNotFoundError:
                self.known = self.initialOffset()
        return self.known

    def latestOffset(self) -> dict:
        known = self._remembered()
        after, done = known["after"], known["done"]
        listed = self._listed()
        waiting = [n for n in sorted(listed) if n > after and str(n) not in done]
        new: list[int] = []
        for n in waiting:
            if len(new) == self.per_batch:
                break
            if self._answers(listed[n]):
                new.append(n)
        if not new:
            return known
        # Up to the last id that is done, below all that wait; the new ones wait too.
        passed = max([after, *(int(n) for n in done if int(n) < waiting[0])])
        kept = {n: url for n, url in done.items() if int(n) > passed}
        return {"after": passed, "done": kept | {str(n): listed[n] for n in new}}

    def partitions(self, start: dict, end: dict) -> list[Item]:
        # Spark has logged this end, so its batch is run until it succeeds: its ids are taken.
        self.known = end
        with open(f"{self.state}.new", "w", encoding="utf-8") as f:
            json.dump(end, f)
        os.replace(f"{self.state}.new", self.state)
        own = {int(n): url for n, url in end["done"].items() if n not in start["done"] and int(n) > start["after"]}
        return [Item(n, own[n]) for n in sorted(own)]

    def read(self, partition: Item | None) -> Iterator[tuple]:
        if partition is None:
            return
        for attempt in range(1, self.search.attempts + 1):
            try:
                html = self.search._open(build_opener(), partition.url)
                break
            except OSError:
                if attempt == self.search.attempts:
                    raise
                time.sleep(self.search.retry)
        yield partition.number, partition.url, html


class PagedSearch(DataSource):
    """search, page (from 1), html and error of the pages of searches, a task for each.

    url: where the form is sent. searches: JSON object, the fields of each by name.
    start: a page that is opened first, in the same session. token: a hidden field of
    that page to be sent along. paging: "links" (default; while a link to the next number
    is there) or "rows" (while the pattern rows is found). firstPageOnly: true for one page.
    pause: seconds between pages. attempts: how often a search is begun whose first page
    fails or, with rows, lists nothing, retry seconds apart: an empty listing isn't an empty
    source. errors: "fail" (default) or "keep": a row with the error, after the pages
    before it.

    As a stream (``spark.readStream``) id, url and html of the pages that are listed, each
    once. The listing is all pages of the searches, or the page url if there are none.
    item: a pattern of links, its group the id, a number. after: ids up to this one
    are left out. perBatch: ids of a batch, at most, the smallest first. state: a file that
    outlives the driver, as the checkpoint does; one stream writes it. A page that doesn't
    answer holds up no other: the watermark stays below it and each batch tries it
    again. One that answers and then fails to be read fails its batch, which runs again,
    whole, when the stream is started again. A listing that fails ends the stream; nothing
    is lost. Ids that are listed late, below the watermark, aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def _items(self) -> bool:
        return any(k.lower() == "item" for k in self.options)

    def schema(self) -> str:
        return ITEM_SCHEMA if self._items() else SCHEMA

    def reader(self, schema) -> _Reader:
        if self._items():
            raise ValueError("item is an option of streams")
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        if not self._items():
            raise ValueError("a stream of paged_search needs the option item")
        return _StreamReader(dict(self.options))
