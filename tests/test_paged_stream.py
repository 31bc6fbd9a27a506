"""The paged search as a stream: each listed page once, over restarts and failures."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerloom.sources import paged


@pytest.fixture()
def site():
    """A listing over two linked pages; ids, those that are down, and those that answer once and then fail, change."""
    now = {"ids": [3, 1, 7], "down": set(), "fails": {}, "read": []}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body, code=200):
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def _list(self, page):
            ids = now["ids"][page - 1 :: 2]
            links = "".join(f"<a href=/get/{n}?x=1&amp;y=2>{n}</a>" for n in ids) + '<a href="/other/9">o</a>'
            self._send(links + ('<a href="/list?page=2">next</a>' if page == 1 else ""))

        def do_GET(self):
            if self.path.startswith("/get/"):
                n = int(self.path[5:].split("?")[0])
                now["read"].append(n)
                if n in now["fails"]:
                    now["fails"][n] -= 1
                    return self._send("", 200 if now["fails"][n] >= 0 else 500)
                return self._send("", 503) if n in now["down"] else self._send(f"page {n} ñ {self.path[-7:]}")
            self._list(int(self.path.split("page=")[1]) if "page=" in self.path else 1)

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self._list(1)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", now
    server.shutdown()


def run(spark, base, folder, **options):
    """One run of the stream over what is there; ids of all rows so far."""
    spark.dataSource.register(paged.PagedSearch)
    given = {"url": f"{base}/list", "searches": '{"a": {"x": "1"}}', "item": r"^/get/(\d+)", "state": f"{folder}/state", "retry": "0"} | options
    rows = spark.readStream.format("paged_search").options(**given).load()
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return got(spark, folder)


def got(spark, folder):
    rows = spark.read.schema(paged.ITEM_SCHEMA).parquet(f"{folder}/out").collect()
    assert all(r.html == f"page {r.id} ñ x=1&y=2" and r.url.endswith(f"/get/{r.id}?x=1&y=2") for r in rows)
    return sorted(r.id for r in rows)


def test_each_page_once_over_restarts(spark, site, tmp_path):
    base, now = site
    assert run(spark, base, tmp_path, after="1") == [3, 7]
    assert run(spark, base, tmp_path, after="1") == [3, 7]
    now["ids"] += [12, 11, 2]
    # The watermark passes 3 and 7 with the next batch; 2 is listed late, but above what was passed.
    assert run(spark, base, tmp_path, after="1", perBatch="2") == [2, 3, 7, 11, 12]
    now["ids"] += [20]
    assert run(spark, base, tmp_path, after="1") == [2, 3, 7, 11, 12, 20]


def test_a_page_that_is_down_holds_up_no_other_and_comes_later(spark, site, tmp_path):
    base, now = site
    now["down"] = {3}
    assert run(spark, base, tmp_path) == [1, 7]
    now["ids"] += [9]
    now["down"] = {3, 7}
    # 7 is done and down now: it isn't given again when it comes back.
    assert run(spark, base, tmp_path) == [1, 7, 9]
    now["down"] = set()
    assert run(spark, base, tmp_path) == [1, 3, 7, 9]
    assert run(spark, base, tmp_path) == [1, 3, 7, 9]


def test_a_batch_with_a_page_that_fails_runs_again(spark, site, tmp_path):
    base, now = site
    now["fails"] = {7: 1}
    with pytest.raises(Exception, match="500"):
        run(spark, base, tmp_path)
    now["fails"], now["ids"] = {}, [3, 1, 7, 8]
    assert run(spark, base, tmp_path) == [1, 3, 7, 8]


def test_without_a_listing_or_options(spark, site, tmp_path):
    base, now = site
    now["ids"] = []
    spark.dataSource.register(paged.PagedSearch)
    folder = str(tmp_path)
    rows = spark.readStream.format("paged_search").options(url=f"{base}/list", item=r"^/get/(\d+)", state=f"{folder}/s").load()
    query = rows.writeStream.format("memory").queryName("nothing_listed").option("checkpointLocation", f"{folder}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("nothing_listed").count() == 0
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("paged_search").options(url=base, item="(x)").load().writeStream.format("memory").queryName("no_state").start().processAllAvailable()
    with pytest.raises(Exception, match="option of streams"):
        spark.read.format("paged_search").options(url=base, item="(x)").load().collect()


def test_the_watermark_stays_below_what_waits(site, tmp_path):
    base, now = site
    reader = paged._StreamReader({"url": f"{base}/list", "searches": '{"a": {}}', "item": r"^/get/(\d+)", "state": str(tmp_path / "s")})
    now["ids"], now["down"] = [1, 2, 3, 4], {2}
    first = reader.latestOffset()
    assert (first["after"], sorted(first["done"])) == (0, ["1", "3", "4"])
    assert [p.number for p in reader.partitions(reader.initialOffset(), first)] == [1, 3, 4]
    assert reader.latestOffset() == first
    now["ids"] += [6]
    second = reader.latestOffset()
    assert (second["after"], sorted(second["done"])) == (1, ["3", "4", "6"])
    assert [p.number for p in reader.partitions(first, second)] == [6]
    now["down"] = set()
    again = paged._StreamReader({"url": f"{base}/list", "searches": '{"a": {}}', "item": r"^/get/(\d+)", "state": str(tmp_path / "s")})
    third = again.latestOffset()
    assert [p.number for p in again.partitions(second, third)] == [2]
