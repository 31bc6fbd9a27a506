"""Meetings of tabular bulletins against a plain state machine."""

import random
import re

from ledgerloom.plans import flows


def squash(x):
    return re.sub(r"\s+", " ", x or "").strip()


def columns(row):
    found = {}
    for k, cell in enumerate(row):
        up = (cell or "").upper()
        for name, marks in (("date", ["FECHA"]), ("time", ["HORA"]), ("body", ["COMISI"]), ("room", ["SALÓN", "SALON"])):
            if any(m in up for m in marks) and name not in found:
                found[name] = k
                break
    return found


def meetings(rows):
    out, now, places, section, waits = [], None, {}, None, False
    for own, row in rows:
        if not row:
            continue
        seen = columns(row)
        if "date" in seen and "time" in seen:
            now, places, section, waits = None, seen, own, True
            continue
        at = lambda name: (row[places[name]] or "") if places.get(name, 99) < len(row) else ""  # noqa: B023, E731
        first = squash(row[0])
        if waits and re.match(r"^\d{1,2}:\d{2}$", squash(at("time"))):
            lines = [x.strip() for x in at("room").split("\n") if x.strip()]
            now = {"section": section, "time": squash(at("time")), "room": lines[0] if lines else "", "bodies": [x.strip() for x in at("body").split("\n") if x.strip()], "agenda": []}
            out.append(now)
            waits = False
        elif now is not None and first and first.upper() != "TEMARIO":
            now["agenda"].append(row[0])
    return [(k + 1, m["section"], m["time"], m["room"], m["bodies"], squash(" ".join(m["agenda"]))) for k, m in enumerate(out)]


def test_meetings_equal_a_state_machine(spark):
    rng = random.Random(9)
    some = ["FECHA", "Fecha y hora", "HORA", "hora", "COMISIÓN", "Salón", "SALON", "9:30", " 10:00 ", "25:99", "a las 9", "TEMARIO", "temario ", "uno", "dos\ntres", "", " ", None, "PAZ\nSALUD"]
    landed, want = [], []
    for b in range(120):
        rows = [(rng.choice(["senadores", "asesores"]), [rng.choice(some) for _ in range(rng.randint(0, 6))]) for _ in range(rng.randint(0, 14))]
        for _ in range(2):
            rows.insert(rng.randint(0, len(rows)), ("senadores", rng.sample(["FECHA", "HORA", "COMISIÓN", "SALÓN", None], 5)))
        landed += [(b, k, s, c) for k, (s, c) in enumerate(rows)]
        want += [(b, *m) for m in meetings(rows)]
    rng.shuffle(landed)
    df = spark.createDataFrame(landed, "b int, k int, section string, cells array<string>")
    found = flows.agenda_log(df, "b", "k", "cells").collect()
    assert sorted((r.b, r.meeting_no, r.section, r.time, r.room, r.bodies, " ".join(i.extract for i in r.agenda)) for r in found) == sorted(want)
    assert flows.agenda_log(df.limit(0), "b", "k", "cells").count() == 0
