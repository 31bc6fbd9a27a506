"""Workbooks (.xlsx) as rows of cells, by the standard library alone."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sheet string, active boolean, row int, cells array<string>, typed array<timestamp_ntz>, error string"
_ARROW = pa.schema([
    ("path", pa.string()), ("sheet", pa.string()), ("active", pa.bool_()), ("row", pa.int32()),
    ("cells", pa.list_(pa.string())), ("typed", pa.list_(pa.timestamp("us"))), ("error", pa.string()),
])
#: Rows that a worker holds before it sends them.
_HELD = 2000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The format's own numbers of formats of dates and times.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self._tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels") if (r.get("Type") or "").endswith("/worksheet")}
        view, props = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView"), book.find(f"{_MAIN}workbookPr")
        active = int(view.get("activeTab", "0")) if view is not None else 0
        self.epoch = datetime.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        #: Name, whether it is the active one, and place of each sheet of cells.
        self.sheets = []
        for k, s in enumerate(book.iterfind(f"{_MAIN}sheets/{_MAIN}sheet")):
            target = targets.get(s.get(f"{_REL}id"))
            if target:
                self.sheets.append((s.get("name"), k == active, target[1:] if target.startswith("/") else f"xl/{target}"))
        self.strings = [self._text(s) for s in self._tree("xl/sharedStrings.xml").iterfind(f"{_MAIN}si")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles() if "xl/styles.xml" in self.zip.namelist() else set()

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    @staticmethod
    def _text(item: ElementTree.Element) -> str:
        """The text of a string, in runs or not, without its phonetic guide."""
        return "".join(t.text or "" for path in (f"{_MAIN}t", f"{_MAIN}r/{_MAIN}t") for t in item.iterfind(path))

    def _date_styles(self) -> set[str]:
        """Numbers of the styles that show dates or times."""
        styles = self._tree("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iterfind(f"{_MAIN}numFmts/{_MAIN}numFmt")}
        dated = {k for k, code in own.items() if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|General', "", code), re.I)}
        of = [int(x.get("numFmtId", "0")) for x in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")]
        return {str(k) for k, n in enumerate(of) if n in dated or (n in _DATES and n not in own)}

    def _moment(self, days: float) -> datetime.datetime:
        """Of a serial number; the calendar from 1900 has a 29th of February in that year."""
        early = self.epoch.year == 1899 and days < 60
        return self.epoch + datetime.timedelta(days=early, seconds=round(days * 86400))

    def _cell(self, c: ElementTree.Element) -> tuple[str | None, datetime.datetime | None]:
        kind, formula, value = c.get("t", "n"), c.findtext(f"{_MAIN}f"), c.findtext(f"{_MAIN}v")
        if formula:
            return "=" + formula, None
        if kind == "inlineStr":
            return self._text(c.find(f"{_MAIN}is")), None
        if value is None:
            return None, None
        if kind == "s":
            return self.strings[int(value)], None
        if kind == "b":
            return ("FALSE", "TRUE")[value == "1"], None
        if kind == "n" and c.get("s") in self.dates:
            return value, self._moment(float(value))
        return value, datetime.datetime.fromisoformat(value.rstrip("Z")) if kind == "d" else None

    def rows(self, place: str) -> Iterator[tuple[int, list, list]]:
        """Number, cells and moments of each row that the sheet holds."""
        with self.zip.open(place) as f:
            row, held = 0, None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    held = e if e.tag == f"{_MAIN}sheetData" else held
                elif e.tag == f"{_MAIN}row":
                    row, cells, typed = int(e.get("r", row + 1)), [], []
                    for c in e.iterfind(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        text, moment = self._cell(c)
                        cells += [None] * (at - len(cells)) + [text]
                        typed += [None] * (at - len(typed)) + [moment]
                    yield row, cells, typed
                    held.clear()


def _column(reference: str) -> int:
    """The place of a cell in its row, from 0, by its reference."""
    at = 0
    for c in reference:
        if c.isalpha():
            at = 26 * at + ord(c.upper()) - 64
    return at - 1


def workbook_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of the sheets of landed workbooks: path, sheet, active, row (from 1), cells,
    typed and error.

    A formula is kept as its text after an equals sign (one that repeats another cell's
    shared formula has its value); other cells are texts as they are stored, null where
    empty. typed holds the moments of cells shown as dates. Rows that a sheet doesn't hold
    are left out, and cells after a row's last. A workbook or a sheet that can't be read
    gives, after what was read of it, a row with an error and no row number; a null
    content is such a one.
    """

    def read(name: str, data: bytes | None) -> Iterator[tuple]:
        try:
            book = Workbook(data or b"")
        except Exception as e:
            yield name, None, None, None, None, None, f"workbook: {type(e).__name__}: {e}"
            return
        for sheet, active, place in book.sheets:
            try:
                for row, cells, typed in book.rows(place):
                    yield name, sheet, active, row, cells, typed, None
            except Exception as e:
                yield name, sheet, active, None, None, None, f"sheet: {type(e).__name__}: {e}"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for k in range(b.num_rows):
                for row in read(b[0][k].as_py(), b[1][k].as_py()):
                    held.append(row)
                    if len(held) == _HELD:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(parsed, SCHEMA)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks at a path, which may be a pattern. Spark passes files of no bytes over."""
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))


def data_rows(rows: DataFrame) -> DataFrame:
    """The rows of active sheets below their first row. Errors among them end the run."""
    failed = F.assert_true(F.col("error").isNull(), F.concat_ws(" ", "path", "error"))
    return rows.where(failed.isNull()).where("active AND row > 1").drop("error")
