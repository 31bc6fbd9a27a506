"""WARC archives: writing captures, reading records, assembling captures.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record; request and metadata name the response's record id in WARC-Concurrent-To, a
revisit names that of the response with its payload in WARC-Refers-To. Archives are
written and read by Spark's own file sources, so any store that Spark knows will do. A
file holds what a partition of the pages does, and a bounded number of records; it is
decompressed and parsed as a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import shared_path, small_batches, trimmed, written

#: Records of an archive file, at most.
FILE_RECORDS = 30_000
#: Payloads that occur more than once, at most, that are broadcast to where pages are read.
BROADCAST_PAYLOADS = 100_000
_CRLF = "\r\n"
#: How a record id is spelt.
_ID = "urn:x-capture:"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, n long, body binary"


def base32(digest: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hexadecimal."""
    bits = F.lpad(F.conv(F.substring(digest, 1, 10), 16, 2), 40, "0")
    for at in (11, 21, 31):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(digest, at, 10), 16, 2), 40, "0"))
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _record(headers: dict[str, Column], body: Column) -> Column:
    """The lines of a record; headers whose value is null are left out. The writer's
    line separator adds the last of the two line breaks that end a record."""
    lines = [F.concat(F.lit(k + ": "), v) for k, v in headers.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    return F.concat(F.concat_ws(_CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(_CRLF * 2), body, F.lit(_CRLF))


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for each page.

    Payloads are body_col in UTF-8, null as empty. Among equal payloads of at least
    revisit_bytes bytes the rows with the smallest id are responses, the others
    revisits of it without a body; a null id is the largest. Smaller payloads are all
    responses. Line breaks in a URL become spaces, a null URL is empty. Repeated rows
    are captures of their own. Record ids hold the row's id and its place among the
    pages, which have to come in the same order each time they are read, as from files.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ")
    read = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), clean.alias("url"), body.alias("body"), F.octet_length(body).alias("n"), F.sha1(body.cast("binary")).alias("sha"))
    read = read.withColumn("row", F.monotonically_increasing_id())
    # Of payloads that several rows have, the row that the others refer to.
    one = F.min(F.struct(F.col("order").isNull().alias("none"), "order", "row", "id", "url"))
    again = written(read.where(F.col("n") >= revisit_bytes).groupBy("sha").agg(one.alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha", "first"), "payloads")
    known = read.join(F.broadcast(again) if again.count() <= BROADCAST_PAYLOADS else again, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("order").eqNullSafe(F.col("first.order"))
    uid = lambda id_, row: F.concat_ws("-", F.coalesce(id_, F.lit("")), row)
    placed = known.withColumn("revisit", revisit).withColumn("body", F.when(F.col("revisit"), "").otherwise(F.col("body"))).withColumn("uid", uid(F.col("id"), F.col("row")))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    rid = lambda kind: F.concat(F.lit(f"<{_ID}{kind}-"), F.col("uid"), F.lit(">"))
    date = F.lit("1970-01-01T00:00:00Z")
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + _CRLF * 2))
    fields = F.concat_ws(_CRLF, F.concat(F.lit("fetchedWith: "), F.lit("ledgerloom")), F.concat(F.lit("payloadBytes: "), F.col("n").cast("string")), F.lit(""))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": date}
    records = F.array(
        _record({"WARC-Type": F.lit("request"), "WARC-Record-ID": rid("request"), "WARC-Concurrent-To": rid("capture"), **common, "Content-Type": F.lit("application/http; msgtype=request")}, request),
        _record(
            {
                "WARC-Type": F.when(F.col("revisit"), "revisit").otherwise("response"),
                "WARC-Record-ID": rid("capture"),
                "WARC-Refers-To": F.when(F.col("revisit"), F.concat(F.lit(f"<{_ID}capture-"), uid(F.col("first.id"), F.col("first.row")), F.lit(">"))),
                "WARC-Refers-To-Target-URI": F.when(F.col("revisit"), F.col("first.url")),
                "WARC-Refers-To-Date": F.when(F.col("revisit"), date),
                "WARC-Profile": F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                "WARC-Payload-Digest": digest,
                **common,
                "Content-Type": F.lit("text/html"),
            },
            F.col("body"),
        ),
        _record({"WARC-Type": F.lit("metadata"), "WARC-Record-ID": rid("metadata"), "WARC-Concurrent-To": rid("capture"), **common, "Content-Type": F.lit("application/warc-fields")}, fields),
    )
    placed.select(F.explode(records).alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", _CRLF).option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a decompressed archive, one at a time, by their Content-Length. What
    isn't a record is skipped up to the next line that begins one, and reported as a
    record of the type malformed whose body is its first line; so is a record that is cut short."""
    line = stream.readline()
    while line:
        if not line.strip():
            line = stream.readline()
            continue
        found, first = {"WARC-Type": "malformed", "body": line}, line
        if line.startswith(b"WARC/"):
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
                headers[name] = value[1:] if value.startswith(" ") else value
            length = headers.get("Content-Length", "")
            if line and length.isdecimal() and headers.get("WARC-Record-ID") and headers.get("WARC-Type"):
                body = stream.read(int(length))
                found = headers | {"body": body} if len(body) == int(length) else {"WARC-Type": "malformed", "body": first}
        yield found
        line = stream.readline()
        if found["WARC-Type"] == "malformed":
            while line and not line.startswith(b"WARC/"):
                line = stream.readline()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record (``RECORD``). What can't be parsed, and a response whose
    payload digest doesn't match its bytes, has the type malformed. Without payloads the
    body of responses is null and only its size is given."""
    names = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "digest", "n", "body"]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                with gzip.GzipFile(fileobj=pa.BufferReader(data.as_buffer())) as stream:
                    for r in parse(stream):
                        kind, own, body = r["WARC-Type"], r.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, r["body"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != own:
                            kind = "malformed"
                        rows.append([r.get("WARC-Record-ID"), kind, r.get("WARC-Concurrent-To"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), own, len(body), body if payloads or kind != "response" else None])
                        held += len(body)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)
        trimmed(None)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, target_uri, request, response (a
    revisit too) and metadata, each a struct of type, record_id, refers_to, digest, n
    and body; null where the archive has no such record. Malformed records don't count."""
    own = F.struct("type", "record_id", "refers_to", "digest", "n", "body")
    kind = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), own), ignorenulls=True)
    keyed = records.where("type <> 'malformed'").withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    return keyed.groupBy("capture_id").agg(F.first("target_uri", ignorenulls=True).alias("target_uri"), kind("request").alias("request"), kind("response", "revisit").alias("response"), kind("metadata").alias("metadata"))


def source_id(record_id: Column) -> Column:
    """The id of the page that a record of ``write_archives`` was made from, null if it had none."""
    return F.nullif(F.regexp_extract(record_id, rf"^<{_ID}\w+-(.*)-\d+>$", 1), F.lit(""))


def with_payload_size(found: DataFrame) -> DataFrame:
    """Captures with payload_bytes: a response's own, a revisit's from the response that it refers to, null without that."""
    bodies = found.where("response.type = 'response'").select(F.col("response.record_id").alias("of"), F.col("response.n").alias("size"))
    referred = found.where("response.type = 'revisit'").select(F.col("response.refers_to").alias("of")).distinct()
    known = referred.join(bodies, "of")
    joined = found.join(known, F.col("response.refers_to") == F.col("of"), "left")
    return joined.withColumn("payload_bytes", F.when(F.col("response.type") == "response", F.col("response.n")).otherwise(F.col("size"))).drop("of", "size")


def captures(pages: DataFrame, revisit_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write archives of pages to the shared folder and return their captures, read back.
    Nulls, repeated rows and further columns as in ``write_archives``; an empty table gives none."""
    path = shared_path(pages.sparkSession, "archives")
    write_archives(pages, path, revisit_bytes)
    return assemble(read_archives(pages.sparkSession, path, payloads))
