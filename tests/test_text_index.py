"""Text facets by an index against plain scans."""

import random

from pyspark.sql import functions as F

from ledgerloom.sources import commits, text_index


def test_searches_equal_scans_over_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BUCKETS", 8)
    path, draw = str(tmp_path), random.Random(3)
    word = lambda: "".join(draw.choice("abÑñ é😀") for _ in range(draw.randrange(0, 12)))
    texts = {k: word() for k in range(300)} | {300: None, 301: "", 302: "x" * 30000 + "ñandú", 303: "ab"}
    frame = lambda found: spark.createDataFrame([(k, t) for k, t in found.items()] + [(None, "ñab aaa")], "id long, body string")
    text_index.update(spark, path, frame(texts), "id", "body")

    def check():
        table = frame(texts)
        for needle in ("ÑAB", "a", "xñandÚ", "aab ", "😀a😀", "zzz"):
            found = sorted(r.id for r in text_index.search(spark, path, table, "id", "body", needle).collect())
            assert found == [k for k, t in sorted(texts.items()) if t is not None and needle.lower() in t.lower()], needle

    check()
    changed = {k: word() for k in range(0, 300, 7)} | {400: "nuevo ñab"}
    texts |= changed
    del texts[5], texts[303]
    text_index.update(spark, path, frame(changed), "id", "body")
    text_index.update(spark, path, frame(changed), "id", "body")
    check()
    before = commits.read(spark, path, "postings").count()
    text_index.update(spark, path, frame(texts), "id", "body", rebuild=True)
    check()
    assert commits.read(spark, path, "postings").count() < before


def test_an_index_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, body string")
    text_index.update(spark, str(tmp_path), none, "id", "body")
    assert text_index.search(spark, str(tmp_path), none, "id", "body", "abc").count() == 0


def test_a_search_reads_under_a_tenth_of_the_files(spark, tmp_path):
    path = str(tmp_path)
    table = spark.range(20000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    text_index.update(spark, path, table, "id", "body")
    files = commits.read(spark, path, "postings").inputFiles()
    keys = text_index.proposed(spark, path, table.where("id = 77").first().body[10:30], "bigint")
    assert [r.key for r in keys.collect()] == [77]
    assert len(files) > 200 and len(keys.inputFiles()) * 10 < len(files)
