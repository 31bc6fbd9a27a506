"""Rosters by stream and by batch, and a plain model of the flow."""

import os
import random
import time

import pytest

from ledgerloom.functions import surnames
from ledgerloom.plans import flows
from ledgerloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_stream_equals_the_batch_and_a_model(spark):
    batch = {r.body: r.members for r in QUERIES["w8_roster_flow"](spark, DATA).collect()}
    assert {r.body: r.members for r in QUERIES["w8_roster_stream"](spark, DATA).collect()} == batch
    letters = lambda k: "".join("ABCDEFGHIJ"[int(c)] if c.isdigit() else c for c in str(k)) + "X"
    customers = spark.read.parquet(f"{DATA}/customer.parquet").orderBy("c_custkey").collect()
    blocs = {f"{letters(c.c_custkey)}": f"bloc {c.c_mktsegment}" for c in customers}
    now = {}
    for c in customers:
        if c.c_custkey <= 100:
            now.setdefault(f"B{c.c_custkey % 25}", []).append((f"{letters(c.c_custkey)}, Ana", blocs[letters(c.c_custkey)], "Presidente" if c.c_custkey % 50 < 25 else ""))
    orders = spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey % 16 = 3").orderBy("o_orderkey").collect()
    key = lambda m: m[0].split(",")[0]
    for o in orders:
        members = now.get(f"B{o.o_custkey % 25}")
        if members is None:
            continue
        for k, new in enumerate((letters(o.o_custkey), letters(o.o_orderkey))):
            role = ""
            # A name with a hyphen isn't one, so nobody is replaced there.
            if k == 0 and o.o_custkey >= 25:
                gone = letters(o.o_custkey - 25)
                at = next((i for i, m in enumerate(members) if gone in key(m) or key(m) in gone), None)
                role = members.pop(at)[2] if at is not None else ""
            if not any(new in key(m) or key(m) in new for m in members):
                members.append((f"{new}, Ana", blocs.get(new, "Sin datos"), role))
    shown = {body: [tuple(x.split(":")) for x in members.split("|") if x] for body, members in batch.items()}
    plain = {body: [(n, b, r) for n, b, r in members] for body, members in now.items()}
    assert {b: [(m[0].upper(), *m[1:]) for m in x] for b, x in shown.items()} == {b: [(m[0].upper(), *m[1:]) for m in x] for b, x in plain.items()}


def test_blocs_by_surname(spark):
    rosters = spark.createDataFrame([("Salud", [])], "body string, members array<struct<name:string,bloc:string,role:string>>")
    decrees = spark.createDataFrame([("1/26", 1, "Artículo 1°- Desígnase a la señora Senadora Ana PAZ y al señor Senador Juan SOL en la Comisión de Salud.")], "number string, ord int, text string")
    persons = spark.createDataFrame([("PÁZ, Zoe", "late"), ("PAZ, Eva", "first"), ("PAZ SOL, Luz", "other")], "name string, bloc string")
    assert [tuple(m) for m in flows.roster_after(rosters, decrees, persons=persons).first().members] == [("PAZ, Ana", "first", ""), ("SOL, Juan", "Sin datos", "")]


def plain_fold(members, changes):
    members = [(m, i, i) for i, m in enumerate(members)]
    for k, (own, gone) in enumerate(changes):
        at = next((i for i, m in enumerate(members) if gone and (gone in m[0] or m[0] in gone)), None)
        role = -1 if at is None else members.pop(at)[2]
        if not any(own in m[0] or m[0] in own for m in members):
            members.append((own, k - 1_000_000, role))
    return members


def test_long_rosters_equal_a_plain_fold():
    draw = random.Random(5)
    name = lambda: "".join(draw.choice("ABCD") for _ in range(draw.choice([0, 2, 5, 6, 7, 7, 8, 8, 9, 12]) if draw.random() < 0.1 else draw.choice([7, 8, 9])))
    for n in (0, 3, 200, 700):
        start, changes = [name() for _ in range(n)], [(name(), name() if draw.random() < 0.7 else "") for _ in range(1500)]
        want = [(n + p + 1_000_000 if p < 0 else p, r) for _, p, r in plain_fold(start, changes)]
        assert surnames.folded(start, changes) == want


def test_time_of_a_fold_grows_with_its_changes():
    """Ten thousand members were compared with each change one by one."""
    began = time.process_time()
    left = surnames.folded([f"A{i:07d}X" for i in range(20_000)], [(f"B{i:07d}X", f"A{i:07d}X") for i in range(0, 20_000, 2)])
    assert len(left) == 20_000 and time.process_time() - began < 10
