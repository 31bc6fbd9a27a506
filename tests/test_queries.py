"""Registered queries against DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_matches_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert columns == sorted(names)
    assert sorted_rows(df.select(*columns).collect()) == sorted_rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_role_fold_query_equals_python(spark):
    rows = lambda sql: duckdb.sql(sql.format(d=DATA)).fetchall()
    surname = lambda m: m[0].split(",")[0]
    members, changes = {}, {}
    for c, k in rows("SELECT o_custkey, o_orderkey FROM '{d}/orders.parquet' ORDER BY o_orderkey"):
        members.setdefault(c, []).append((f"S{k}, X", f"r{k}"))
    lines = "SELECT o_custkey, l_orderkey, l_partkey FROM '{d}/lineitem.parquet' JOIN '{d}/orders.parquet' ON l_orderkey = o_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey"
    for c, k, p in rows(lines):
        changes.setdefault(c, []).append((f"T{p % 50}, Y", f"S{k}"))
    for c, own in members.items():
        for name, gone in changes.get(c, []):
            at = next((i for i, m in enumerate(own) if gone in surname(m) or surname(m) in gone), None)
            role = own.pop(at)[1] if at is not None else ""
            new = surname((name,))
            if not any(new in surname(m) or surname(m) in new for m in own):
                own.append((name, role))
    found = {r.o_custkey: r.members for r in __spark_entry__.queries()["w8_role_fold"](spark, DATA).collect()}
    assert found == {c: "|".join(":".join(m) for m in own) for c, own in members.items()}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
