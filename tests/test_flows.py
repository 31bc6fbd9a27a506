"""Listings, orders of the day, persons, sections and views on small inputs, against plain Python."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import merge, ordered
from ledgerloom.plans import dayorders, people, views, workbook
from ledgerloom.sources import listings


def test_names_of_bodies_keep_all_their_letters(spark):
    lines = ["CULTURA", "🗓 MARTES 3 DE MARZO 🕑 10:30 📍 X", "S-1/26 a.", "una (b | Columna'", "🗓 LUNES 2 DE MARZO 🕑 9 📍 Y"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "b int, k int, line string")
    found = ordered.free_text_meetings(df, "b", "k", "line", ["CULTURA"]).orderBy("meeting_no").collect()
    assert [r.bodies for r in found] == [["CULTURA"], ["una (b", "Columna'"]]
    names = spark.createDataFrame([("CULTURA",), ("ULTURA",), ("x | CULTURA ",), (None,)], "line string")
    assert [r[0] for r in names.select(F.coalesce(ordered.body_names(F.col("line"), ["CULTURA"]), F.lit(False))).collect()] == [True, False, True, False]


def test_day_orders_of_null_and_empty_rows(spark):
    schema = "ord int, period int, number string, kind string, codes string, codes_url string, extract string, bodies string, date string, file_url string, extra string"
    rows = [(1, 2026, "3", None, None, "u", None, None, None, None, "e"), (2, None, "4", *[None] * 8), (3, 2026, None, *[None] * 8)]
    found = dayorders.day_orders(spark.createDataFrame(rows, schema), {"S": "Senado"}, {"PL": "Ley"}).collect()
    assert [(r.number, r.kind, r.origin, r.category, r.author, r.description, r.cases, r.bodies) for r in found] == [("3", "NORMAL", "", "", None, "", [], [])]
    sheets = spark.createDataFrame([], "sheet string, row int, order string, typed timestamp, signers string, lead string")
    enriched = dayorders.enriched(dayorders.day_orders(spark.createDataFrame(rows, schema), {"S": "Senado"}, {"PL": "Ley"}), dayorders.enrichments(sheets), "", "Own").collect()
    assert [(r.signers, r.lead) for r in enriched] == [(None, "Own")]


def test_people_equal_a_dictionary(spark):
    rng = random.Random(5)
    now = [(k, rng.choice(["UCR", "ucr ", "Ünión", "UNION", "", None]), rng.choice(["Paz", " ROJO", "", None]), rng.choice(["Ana", "ana ", None]), " Chaco") for k in range(30)]
    before = [(k, rng.choice(["Paz, Ana", " sol ,  eva", "LUZ", "", None]), "Salta", rng.choice(["Ucr", "Otro", "OTRÓ"])) for k in range(30)]
    plain = lambda b: "".join({"Ü": "U", "Ó": "O", "ó": "o"}.get(c, c) for c in b).upper()
    spelt, want = {}, {}
    for _, b, s, g, p in now:
        if s:
            bloc = (b or "Sin datos").strip()
            name = (f"{s.strip()}, {g.strip()}" if g else s.strip()).upper()
            want[name] = (spelt.setdefault(plain(bloc), bloc), p.strip(), True)
    for _, n, d, b in before:
        name = ", ".join(x.strip() for x in (n or "").split(",")).upper()
        if name and name not in want:
            want[name] = (spelt.setdefault(plain(b), b), d.upper(), False)
    current = spark.createDataFrame(now, "ord int, bloc string, surname string, given string, province string")
    former = spark.createDataFrame(before, "ord int, name string, district string, bloc string")
    assert {r.name: (r.bloc, r.province, r.current) for r in people.people(current, former, "Sin datos").collect()} == {n: (b, p, c) for n, (b, p, c) in want.items()}


def test_sections_carry_over_pages(spark):
    words = [("d", 1, 10.0, 1.0, "REUNIONES"), ("d", 1, 11.6, 2.0, "BICAMERAL"), ("d", 3, 5.0, 1.0, "REUNIONES"), ("d", 3, 5.4, 2.0, "BICAMERAL"), ("e", 1, 10.0, 1.0, "x")]
    tables = [("d", 1, 0, 4.0, [["a"]]), ("d", 1, 1, 10.0, [["b"], ["c"]]), ("d", 2, 0, 1.0, [["d"]]), ("e", 1, 0, 99.0, [["e"]]), ("e", 2, 0, 99.0, [])]
    w = spark.createDataFrame(words, "doc string, page int, top double, x0 double, text string")
    t = spark.createDataFrame(tables, "doc string, page int, tbl int, top double, rows array<array<string>>")
    found = ordered.section_rows(w, t, {"bicameral": r"REUNIONES\s+BICAMERAL"}, "senadores").collect()
    assert sorted((r.cells[0], r.row, r.section) for r in found) == [("a", 0, "senadores"), ("b", 0, "bicameral"), ("c", 1, "bicameral"), ("d", 0, "bicameral"), ("e", 0, "senadores")]


def test_listings_without_anything(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table></table>")], "k int, html string")
    assert listings.bulletin_links(pages, "k", "html", "b").count() == 0
    assert listings.decree_rows(pages, "k", "html", "b").count() == 0
    rows = spark.createDataFrame([(None, None, "u"), ("1-2-3", None, "u"), ("2", "2019", "u"), ("3", " 2020 -1", "u")], "number string, date string, url string")
    assert [(r.number, r.date) for r in listings.session_bulletins(rows, 2020).orderBy("number").collect()] == [("1/2-3", ""), ("3", "2020 -1")]


def test_window_whose_start_is_no_date(spark):
    rows = spark.sql("SELECT date'2026-01-10' AS at UNION ALL SELECT date'2025-12-11' UNION ALL SELECT date'2025-12-10' UNION ALL SELECT date'2026-01-11' UNION ALL SELECT null")
    as_of = F.lit("2026-01-10").cast("date")
    assert [listings.in_window(rows, "at", as_of, 30, since).count() for since in (None, "10/12/2025", "x")] == [2, 3, 0]


def test_views_of_nulls_and_repeats(spark):
    records = spark.createDataFrame([("S", 1, 2026, "AC", "u", "x"), ("S", 1, 2026, "AC", "v", "y"), (None, None, None, None, None, None)], "origin string, number int, year int, kind string, url string, extract string")
    outcomes = spark.createDataFrame([("S.-1/26", "ley", None, None, None, 1), (None, "preferencia", "x", None, None, 2), ("S 1/26", "preferencia", "Aprobada", None, None, 3)], "code string, section string, result string, observations string, date string, ord int")
    shown = views.with_outcomes(records, outcomes).collect()
    assert sorted((r.url or "", r.preference, r.enacted, r.enacted_text) for r in shown) == [("", False, False, None), ("u", True, False, None), ("v", True, False, None)]
    assert sorted((r.ord, r.url) for r in views.with_records(outcomes, records).collect()) == [(1, "u"), (2, None), (3, "u")]
    agreed = spark.createDataFrame([(1, 2026, None), (1, 2026, True)], "number int, year int, announced boolean")
    assert views.with_agreements(records, agreed, ["announced"]).count() == 3
    log = spark.createDataFrame([("A", None), ("A", "B"), (None, "")], "designated string, replaced string")
    assert sorted((r.person, r.part) for r in views.histories(log, []).collect()) == [("A", "designated"), ("A", "designated"), ("B", "replaced")]
    none = outcomes.where("ord > 9")
    assert merge.watermark(none, none, "ord").first().watermark is None


def test_tabular_records_of_nulls(spark):
    names = ["ord int", *(f"{c} string" for c in ("NRO", "ANIO", "TIPO", "ORIGEN", "CARATULA", "MESA", "DAE", "AUTOR", "COM1", "COM2", "COM3", "COM4", "COM5"))]
    rows = [(1, "7", *[None] * 12), (2, "7", *[None] * 12), (3, "x", *[None] * 12)]
    known = spark.createDataFrame([], "number int, year int, kind string")
    (found,) = workbook.tabular_records(spark.createDataFrame(rows, ", ".join(names)), known, {"PL": "Bill"}, "b").collect()
    assert found.asDict() == {"number": 7, "year": 2025, "kind": "PL", "kind_label": "Bill", "extract": "", "authors": [], "coauthors": [], "bodies": [], "date": "", "entry": "", "origin": "S", "url": "b/7.25/S/PL"}
