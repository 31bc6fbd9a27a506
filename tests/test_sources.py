"""Workbooks, landed tables and paged searches, against small ones made here."""

import datetime
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merge
from ledgerloom.sources import paged, tables, workbooks
from ledgerloom.streaming import incremental

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made(sheets, strings=(), props="", active=0):
    """A workbook of (name, rows as XML), with styles: 0 plain, 1 a date, 2 an own date, 3 an own number."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}>{props}<bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
        links = "".join(f'<Relationship Id="r{k}" Type="{kind}" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        formats = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}>{formats}<cellXfs>{"".join(f"<xf numFmtId={chr(34)}{n}{chr(34)}/>" for n in (0, 14, 170, 171))}</cellXfs></styleSheet>')
        for k, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


ROWS = """<row r="1"><c r="A1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>HYPERLINK("u","7")</f><v>7</v></c><c r="D3"><v>12</v></c><c r="AB3" t="b"><v>1</v></c></row>
<row><c t="inlineStr"><is><t>in</t></is></c><c s="1"><v>46023.5</v></c><c s="2"><v>1</v></c><c s="3"><v>2.5</v></c><c s="1"/><c t="str"><f t="shared" si="0"/><v>z</v></c></row>"""
STRINGS = ("<t>Title</t>", "<r><t>Ro</t></r><r><t xml:space='preserve'>w </t></r><rPh><t>no</t></rPh>")


def test_workbook_cells(spark):
    content = made([("one", ""), ("two", ROWS)], STRINGS, active=1)
    rows = workbooks.workbook_rows(spark.createDataFrame([("p", bytearray(content))], "path string, content binary"))
    found = {r.row: r for r in rows.collect()}
    assert sorted(found) == [1, 3, 4] and {(r.sheet, r.active, r.error) for r in found.values()} == {("two", True, None)}
    assert found[3].cells == ["Row ", None, '=HYPERLINK("u","7")', "12", *[None] * 23, "TRUE"] and set(found[3].typed) == {None}
    assert found[4].cells == ["in", "46023.5", "1", "2.5", None, "z"]
    assert found[4].typed == [None, datetime.datetime(2026, 1, 1, 12), datetime.datetime(1900, 1, 1), None, None, None]
    assert [r.row for r in workbooks.data_rows(rows).orderBy("row").collect()] == [3, 4]


def test_workbooks_from_1904(spark):
    content = made([("s", '<row><c s="1"><v>0</v></c></row>')], props='<workbookPr date1904="1"/>')
    rows = workbooks.workbook_rows(spark.createDataFrame([("p", bytearray(content))], "path string, content binary"))
    assert rows.first().typed == [datetime.datetime(1904, 1, 1)]


def test_workbooks_that_cannot_be_read(spark, tmp_path):
    good, broken = made([("s", "<row><c><v>1</v></c></row>"), ("t", "<row><c><v>2</v></c></row>")]), made([("s", '<row><c><v>1</v></c></row><row><c t="s"><v>9</v></c></row>'), ("t", "<row><c><v>2</v></c></row>")])
    for name, content in (("good.xlsx", good), ("broken.xlsx", broken), ("empty.xlsx", b"PK"), ("other.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    found = sorted((r.path.rsplit("/", 1)[1], r.sheet or "", r.row or 0, (r.cells or [""])[0], (r.error or "").split(":")[0]) for r in rows.collect())
    assert found == [
        ("broken.xlsx", "s", 0, "", "sheet"), ("broken.xlsx", "s", 1, "1", ""), ("broken.xlsx", "t", 1, "2", ""), ("empty.xlsx", "", 0, "", "workbook"), ("good.xlsx", "s", 1, "1", ""), ("good.xlsx", "t", 1, "2", ""),
    ]
    with pytest.raises(Exception, match="workbook"):
        workbooks.data_rows(rows).collect()
    none = spark.createDataFrame([("n", None)], "path string, content binary")
    assert workbooks.workbook_rows(none).first().error.startswith("workbook") and workbooks.workbook_rows(none.where("false")).count() == 0


def test_workbook_of_many_rows(spark):
    content = made([("s", "".join(f"<row><c><v>{k}</v></c></row>" for k in range(5001)))])
    rows = workbooks.workbook_rows(spark.createDataFrame([("p", bytearray(content))], "path string, content binary"))
    assert rows.agg(F.count("*"), F.sum(F.col("cells")[0].cast("long") - F.col("row") + 1)).first() == (5001, 0)


def test_tables_with_errors_at_each_level(spark):
    pages = [
        ("a", 1, json.dumps([[["x ", None], ["y\n z", "2"]], [], [["w"]]])), ("a", 2, "[]"), ("a", 3, "[[[1"), ("a", 4, json.dumps([[["k"], "text", None]])), ("a", 5, json.dumps(["no table", [["v"]]])), ("a", 6, None), ("b", None, None),
    ]
    rows = tables.table_rows(spark.createDataFrame(pages, "doc string, page int, tables string"), "doc", "page", "tables")
    found = [tuple(r) for r in rows.orderBy("doc", "page", "tbl", "row").collect()]
    assert found == [
        ("a", 1, 0, 0, ["x", ""], None), ("a", 1, 0, 1, ["y z", "2"], None), ("a", 1, 2, 0, ["w"], None), ("a", 3, None, None, None, "page"), ("a", 4, 0, 0, ["k"], None), ("a", 4, 0, 1, None, "row"), ("a", 4, 0, 2, None, "row"),
        ("a", 5, 0, None, None, "table"), ("a", 5, 1, 0, ["v"], None), ("a", 6, None, None, None, "page"), ("b", None, None, None, None, "document"),
    ]


@pytest.fixture(scope="module")
def site():
    """Searches by year with as many pages as its last digit; 2003 answers emptily at first, 2004 fails on its third page."""
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body, code=200, cookie=None):
            self.send_response(code)
            if cookie:
                self.send_header("Set-Cookie", f"year={cookie}")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def _page(self, year, page, cookie=None):
            last = int(year) % 10
            rows = f"<tr><td>{year}-{page} ñ</td></tr>" if page <= last else ""
            link = f'<a href="/list?x=1&amp;page={page + 1}">next</a>' if page < last else '<a href="/list?page=1">first</a>'
            self._send(f"<table>{rows}</table>{link}", cookie=cookie)

        def do_GET(self):
            asked = parse_qs(urlparse(self.path).query)
            if "page" not in asked:
                return self._send('<input type="hidden" value="a&amp;b" name="form[_token]">')
            year, page = self.headers["Cookie"].split("year=")[1][:4], int(asked["page"][0])
            return self._send("", 500) if (year, page) == ("2004", 3) else self._page(year, page)

        def do_POST(self):
            sent = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            year = sent["year"][0]
            calls.append(year)
            if sent.get("form[_token]") != ["a&b"]:
                return self._send("", 403)
            return self._send("<table></table>", cookie=year) if year == "2003" and calls.count(year) == 1 else self._page(year, 1, year)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/list", calls
    server.shutdown()


def searched(spark, url, years, **options):
    spark.dataSource.register(paged.PagedSearch)
    searches = json.dumps({y: {"year": y} for y in years})
    rows = spark.read.format("paged_search").options(url=url, start=url, token="form[_token]", searches=searches, retry="0", **options).load().collect()
    return sorted((r.search, r.page, (r.html or "").split("<td>")[-1].split("<")[0], (r.error or "").split(":")[0]) for r in rows)


@pytest.mark.parametrize("paging", [{"paging": "links"}, {"paging": "rows", "rows": "<td>"}])
def test_pages_of_searches(spark, site, paging):
    want = [(y, k, f"{y}-{k} ñ", "") for y in ("2001", "2002") for k in range(1, int(y) % 10 + 1)]
    assert searched(spark, site[0], ["2001", "2002"], **paging) == want
    assert searched(spark, site[0], ["2001", "2002"], firstPageOnly="true", **paging) == [w for w in want if w[1] == 1]
    assert searched(spark, site[0], [], **paging) == []


def test_empty_listing_is_tried_again(spark, site):
    site[1].clear()
    assert searched(spark, site[0], ["2003", "2000"], attempts="3", paging="rows", rows="<td>") == [("2003", k, f"2003-{k} ñ", "") for k in (1, 2, 3)]
    assert (site[1].count("2003"), site[1].count("2000")) == (2, 3)


def test_failing_pages(spark, site):
    assert searched(spark, site[0], ["2004"], errors="keep") == [("2004", 1, "2004-1 ñ", ""), ("2004", 2, "2004-2 ñ", ""), ("2004", 3, "", "HTTPError")]
    with pytest.raises(Exception, match="500"):
        searched(spark, site[0], ["2004"])
    with pytest.raises(Exception, match="needs the option"):
        searched(spark, site[0], ["2001"], paging="rows")


def test_upserts_of_many_batches_equal_the_batch_operator(spark, tmp_path):
    schema, keys, order = "k int, g string, at int, v string", ["k", "g"], ["at", "v"]
    rows = [(n * 7 % 5 if n % 11 else None, "ab"[n % 2], n * 13 % 37, f"v{n}") for n in range(60)]
    source, target, log = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    plain = lambda df: sorted(map(repr, df.collect()))
    for end in (30, 60):
        for n in range(end - 30, end, 6):
            spark.createDataFrame(rows[n : n + 6], schema).coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(spark, source, schema, target, log, keys, order, "at", compact_every=2, files=1)
        whole = spark.createDataFrame(rows[:end], schema).withColumn("__place", F.col("at"))
        assert plain(incremental.read_upserted(spark, target, keys, order)) == plain(merge.last_wins(whole, keys, order, "__place"))
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "target" / "log").iterdir())
    assert left == [8, 9]
    before = plain(incremental.read_upserted(spark, target, keys, order))
    incremental.upsert_stream(spark, source, schema, target, log, keys, order, "at", compact_every=2, files=1)
    assert plain(incremental.read_upserted(spark, target, keys, order)) == before


def test_last_rows_equal_a_fold(spark):
    rows = [(n % 3 if n % 7 else None, n * 5 % 11 if n % 4 else None, n) for n in range(40)]
    want, first = {}, {}
    for k, at, n in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        want[k] = (k, at)
        first[k] = min(n, first.get(k, n))
    df = spark.createDataFrame(rows, "k int, at int, n int").withColumn("id", F.col("n"))
    found = merge.last_wins(df, ["k"], ["at", "id"], "n").collect()
    assert {r.k: (r.k, r.at) for r in found} == want and {r.k: r.n for r in found} == first and len(found) == len(want)
    assert merge.last_wins(df.where("false"), ["k"], ["at"], "n").count() == 0


def test_table_without_batches(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        incremental.read_upserted(spark, str(tmp_path), ["k"], ["k"])
    assert incremental.read_upserted(spark, str(tmp_path), ["k"], ["k"], "k int, __place int").count() == 0
