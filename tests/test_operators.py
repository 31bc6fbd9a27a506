"""Ordered state and merges against folds in plain Python; sources, sinks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, merge, ordered
from ledgerloom.plans import flows
from ledgerloom.sources import landing, sinks

ROSTER = "name string, bloc string, role string"


def test_current_state_equals_a_fold(spark):
    rng = random.Random(2)
    log = [(b, n, f"{rng.randrange(3)}" if rng.random() < 0.9 else "", rng.randrange(4)) for b in range(12) for n in range(rng.randrange(5))]
    state = {}
    for batch in range(12):
        own = {(s, k) for b, _, s, k in log if b == batch}
        covered = {s for s, _ in own}
        for s, k in list(state):
            if s and s in covered:
                state[s, k] = (s, k) not in own
        state.update({x: False for x in own})
    df = spark.createDataFrame([(b, n, s, k) for b, n, s, k in log], "bid int, n int, scope string, k int")
    found = ordered.current_state(df, "bid", "scope", ["scope", "k"], ["n"]).collect()
    assert {(r.scope, r.k): r.suspended for r in found} == state


def test_sessionize_equals_a_state_machine(spark):
    rng = random.Random(7)
    rows = [(g, k, rng.choice("hdii")) for g in range(30) for k in range(rng.randrange(12))]
    want, now = [], {}
    for g, k, kind in rows:
        if kind == "h":
            now[g] = (now.get(g, (0,))[0] + 1, None, [])
        elif g in now:
            n, first, items = now[g]
            if kind == "d" and first is None:
                now[g] = (n, k, items)
                want.append((g, n, k, items))
            elif first is not None:
                items.append(f"{kind}{k}")
    df = spark.createDataFrame(rows, "g int, k int, kind string")
    kind = F.col("kind")
    found = ordered.sessionize(df, ["g"], ["k"], kind == "h", kind == "d", F.concat(kind, F.col("k").cast("string")))
    assert sorted((r.g, r.group_no, r.first_order, [i.item for i in r["items"]]) for r in found.collect()) == sorted(want)


def test_roster_fold_equals_python(spark):
    rng = random.Random(11)
    names = ["PAZ, A", "PAZ SOL, B", "ROJO, C", "LUNA, D", "MAR, E"]
    cases = [([(n, "b", f"r{k}") for k, n in enumerate(rng.sample(names, 3))], [(rng.choice(names), "", rng.choice(["PAZ", "SOL", "ROJO", "LUNA", "", None])) for _ in range(rng.randrange(6))]) for _ in range(150)]

    def fold(members, changes):
        members = list(members)
        for name, bloc, gone in changes:
            role = ""
            for i, m in enumerate(members):
                s = m[0].split(",")[0]
                if gone and (gone in s or s in gone):
                    role = m[2]
                    del members[i]
                    break
            new = name.split(",")[0]
            if not any(new in s or s in new for s in (m[0].split(",")[0] for m in members)):
                members.append((name, bloc, role))
        return members

    schema = f"k int, members array<struct<{ROSTER.replace(' ', ':').replace(',:', ',')}>>, changes array<struct<name:string,bloc:string,replaced:string>>"
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], schema)
    found = {r.k: [tuple(m) for m in r.m] for r in df.select("k", ordered.fold_roster(F.col("members"), F.col("changes")).alias("m")).collect()}
    assert found == {k: fold(*c) for k, c in enumerate(cases)}


def test_free_text_bulletin(spark):
    lines = ["N° 12/26", "AGENDA DE SENADORES", "Salud", "🗓 MARTES 3 DE MARZO 🕑 10:30 H 📍 SALÓN AZUL", "📋 TEMARIO", "S-1/26 uno.", "JUSTICIA", "🗓 LUNES 4 DE MARZO 🕑 A continuación 📍 Salón Rojo", "PE-2/26 dos.", "EXPOSITORES: alguien", "otro", "AGENDA DE ASESORES", "BICAMERAL DE X | OTRA", "🗓 LUNES 4 DE BRUMARIO 🕑 9 📍 X"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)] + [(2, 0, None)], "b int, k int, line string")
    found = ordered.free_text_meetings(df, "b", "k", "line", ["SALUD"]).orderBy("meeting_no").collect()
    assert [(r.section, r.date, r.time, r.room, r.bodies, [(i.number, i.extract) for i in r.agenda], r.kind) for r in found] == [
        ("senadores", "03/03", "10:30", "AZUL", ["Salud"], [("S-1/26", "uno")], "senadores"),
        ("senadores", "04/03", "A continuación", "Rojo", ["JUSTICIA"], [("PE-2/26", "dos")], "senadores"),
        ("asesores", "", "9", "X", ["BICAMERAL DE X", "OTRA"], [], "bicameral"),
    ]


def test_free_text_bulletins_equal_a_state_machine(spark):
    rng = random.Random(21)
    spelt = {"date": "🗓 MARTES 3 DE MARZO 🕑 10:30 📍 X", "section": "AGENDA DE ASESORES", "none": "NO HAY REUNIONES", "update": "*SE ACTUALIZARÁ", "speakers": "EXPOSITORES: x", "mark": "📋 TEMARIO", "name": "SALUD", "text": "S-1/26 a."}
    rows = [(g, k, rng.choice([*spelt, "date", "name", "text", "text"])) for g in range(200) for k in range(rng.randrange(14))]
    want, state = [], {}
    for g, k, kind in rows:
        s = state.setdefault(g, {"open": None, "waiting": [], "talking": False, "n": 0})
        named = kind == "name" and s["open"] is not None
        if kind in ("section", "none", "update", "date") or named:
            s["open"] = None
        if kind in ("section", "none", "date") or named:
            s["talking"] = False
        if kind == "date":
            s["n"] += 1
            # Short lines count only where there are no others.
            s["open"] = [g, s["n"], s["waiting"].count("name") or len(s["waiting"]), 0]
            want.append(s["open"])
        if kind in ("section", "none", "date") or named:
            s["waiting"] = ["name"] * named
        elif kind in ("name", "text") and s["open"] is None:
            s["waiting"].append(kind)
        elif kind == "text" and not s["talking"]:
            s["open"][3] += 1
        elif kind == "speakers":
            s["talking"] = True
    df = spark.createDataFrame([(g, k, spelt[kind]) for g, k, kind in rows], "b int, k int, line string")
    found = ordered.free_text_meetings(df, "b", "k", "line", ["SALUD"]).collect()
    assert sorted([r.b, r.meeting_no, len(r.bodies), len(r.agenda)] for r in found) == sorted(want)


def test_merged_lines(spark):
    words = [(1, 10.0, 5.0, "b"), (1, 11.5, 1.0, "a"), (1, 12.5, 0.0, "c"), (1, 30.0, 0.0, "d")]
    df = spark.createDataFrame(words, "page int, top double, x double, word string")
    assert [r.text for r in ordered.merged_lines(df, ["page"], "top", "word", "x").orderBy("line_no").collect()] == ["a b", "c", "d"]


def test_dedup_and_priority(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 1, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in merge.first_wins(df, ["k"], ["o"]).collect()} == {("a", "x"), (None, "w")}
    assert {(r.k, r.v, r.p) for r in merge.last_wins(df.withColumn("p", F.col("o")), ["k"], ["o"], "p").collect()} == {("a", "y", 1), (None, "z", 1)}
    second = spark.createDataFrame([("a", 0, "no"), ("b", 2, "late"), ("b", 1, "early")], "k string, o int, v string")
    assert {(r.k, r.v) for r in merge.priority_union(df.where("k = 'a'"), second, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "early")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿NRO,"AÑO"\n1,"a ""q"" b"\n,2\n', encoding="utf-8")
    df = landing.with_defaults(landing.read_csv(spark, f"{tmp_path}/x.csv", ["NRO", "AÑO", "TIPO"]), {"NRO": "0", "TIPO": "PL"})
    assert sorted(map(tuple, df.collect())) == [("0", "2", "PL"), ("1", 'a "q" b', "PL")]
    assert landing.read_json(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "m.json").write_text('{"B": {"v": 1}, "A": {"v": 2}}')
    assert [(r.key, r.value.v) for r in landing.read_map(spark, f"{tmp_path}/m.json", "struct<v:int>").orderBy("ord").collect()] == [("B", 1), ("A", 2)]
    cells = spark.createDataFrame([(1, "t", ""), (2, "ORIGEN", "N"), (3, "S", ""), (4, "S", "9")], "o int, c0 string, c1 string")
    assert [r.o for r in landing.below_header(cells, "o", "ORIGEN").collect()] == [4]
    with pytest.raises(ValueError):
        landing.below_header(cells.where("o = 1"), "o", "ORIGEN")
    for n in (1, 2):
        sinks.write_snapshot(spark.range(n), f"{tmp_path}/snap", ["id"])
    assert sinks.read_snapshot(spark, f"{tmp_path}/snap").count() == 2


def test_flows(spark):
    rosters = spark.createDataFrame([("Salud", [("ROJO, Juan", "b", "presidente")])], f"body string, members array<struct<{ROSTER.replace(' ', ':').replace(',:', ',')}>>")
    decrees = spark.createDataFrame([("1/26", 1, "Artículo 1°- Desígnase a la señora Senadora Ana PAZ en la Comisión de Salud, en reemplazo del señor Senador Juan ROJO.")], "number string, ord int, text string")
    assert [tuple(m) for m in flows.roster_after(rosters, decrees).first().members] == [("PAZ, Ana", "", "presidente")]
    texts = ["Artículo 1°- Desígnase al señor Senador Juan SOL y a la señora Senadora Eva MAR en la Comisión de Salud, en reemplazo de la señora Senadora Ana PAZ.", "Artículo 1°- Desígnase al señor Senador Luis LUNA en la Comisión de Salud Pública."]
    more = decrees.unionByName(spark.createDataFrame([(f"{k}/26", k, t) for k, t in enumerate(texts, 2)], "number string, ord int, text string"))
    assert [(r.kind, r.designated, r.replaced) for r in flows.designations(more).orderBy("ord", "pair_no").collect()] == [
        ("replace", "PAZ, Ana", "ROJO, Juan"), ("replace", "SOL, Juan", "PAZ, Ana"), ("add", "MAR, Eva", None), ("add", "LUNA, Luis", None)]
    # Who is added without replacing anyone removes nobody; a longer name finds the body that it contains.
    assert [tuple(m) for m in flows.roster_after(rosters, more).first().members] == [("SOL, Juan", "", "presidente"), ("MAR, Eva", "", ""), ("LUNA, Luis", "", "")]
    cells = [(1, ["PROYECTOS DE LEY"]), (2, ["12", "S-1/26 y P.E-2/26", "APROBADO", "obs"]), (3, ["S-3/26", "x", "APROBADO"]), (4, ["CAMBIO DE GIRO"]), (5, ["1", "S-4/26", "x", "y"]), (6, ["MOCIONES DE PREFERENCIA"]), (7, ["S-5/26", " aprobada", ""]), (8, ["S-6/26", "RECHAZADA", "APROBADA"]), (9, ["OD", "ACUERDOS CONSIDERADOS", "RESULTADO", "OBSERVACIONES"]), (10, ["S/T", "PE-7/26", "R", ""])]
    rows = spark.createDataFrame([("1", k, 0, k, c) for k, c in cells], "bulletin string, page int, tbl int, row int, cells array<string>")
    found = flows.outcomes(rows, flows.session_header(F.col("cells")), F.get(F.col("cells"), F.lit(0)) == "CAMBIO DE GIRO").orderBy("row", "code").collect()
    assert [(r.code, r.section, r.order_number, r.result, r.observations) for r in found] == [
        ("PE-2/26", "ley", 12, "APROBADO", "obs"), ("S-1/26", "ley", 12, "APROBADO", "obs"), ("S-5/26", "preferencia", None, " aprobada", ""), ("PE-7/26", "acuerdo", None, "R", "")]
    known = spark.createDataFrame([(1, None, "", None)], "nro int, ley string, fecha string, reviewed string")
    new = flows.incremental_records(known, spark.createDataFrame([(1,), (2,)], "nro int"), spark.createDataFrame([(1, "27", ""), (2, None, "f")], "nro int, ley string, fecha string"), ["nro"], ["nro"], ["ley", "fecha"], F.lit("2026-01-01"))
    assert sorted(map(tuple, new.collect())) == [(1, "27", "", "2026-01-01"), (2, None, "f", "2026-01-01")]
    # A record that was looked at is stamped though nothing changed; one that wasn't isn't.
    known = spark.createDataFrame([(1, "27", "", "2025-01-01"), (2, "", "", "2025-01-01")], "nro int, ley string, fecha string, reviewed string")
    same = flows.incremental_records(known, known.select("nro").limit(0), known.where("nro = 1").select("nro", "ley", "fecha"), ["nro"], ["nro"], ["ley", "fecha"], F.lit("2026-01-01"))
    assert sorted(map(tuple, same.collect())) == [(1, "27", "", "2026-01-01"), (2, "", "", "2025-01-01")]


def test_facets(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c"])], "k int, c array<string>")
    ids = lambda **f: sorted(r.k for r in analytics.faceted(df, **f).collect())
    assert ids(first={"c": "a"}) == [1] and ids(later={"c": "a"}) == [2] and ids(holds={"c": "a"}) == [1, 2]
    with pytest.raises(ValueError):
        analytics.conditional_facet(df, ["a", "b"], "a", "k", F.lit(True))
