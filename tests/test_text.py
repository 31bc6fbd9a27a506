"""Scalar functions against golden values and plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.operators import extract


def one(spark, column, *cells):
    df = spark.createDataFrame([tuple(cells)], ", ".join(f"c{k} string" for k in range(len(cells))))
    return df.select(column(*(F.col(f"c{k}") for k in range(len(cells)))).alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "cell", "want"),
    [
        (text.title_particles, "CAPITANICH Y OTROS", "Capitanich y Otros"),
        (text.referrals, "DE SALUD - DE Y -  - DE SALUD", ["De Salud", "De y"]),
        (text.code_kind, "PE-231/26-AC", "AC"),
        (text.code_kind, "PE-231/26", ""),
        (values.slashed_date, "24-06-2026", "24/06/2026"),
        (values.slashed_date, "SIN FECHA", None),
        (text.roster_key, "De Legislación General", "LEGISLACION GENERAL"),
        (text.surname_first, "Enrique Martín GOERLING LARA", "GOERLING LARA, Enrique Martín"),
        (text.person_key, "  Blanco, Pablo Daniel ", "BLANCO, PABLO DANIEL"),
        (text.title_each, "D'ANGELO", "D'Angelo"),
        (text.sentence_case, "SOLICITA INFORMES. DE LA 8VA NACIÓN (24) Y", "Solicita Informes. De la 8va Nación (24) y"),
        (text.signers, "LÓPEZ. – PÉREZ - GÓMEZ", ["LÓPEZ", "PÉREZ", "GÓMEZ"]),
        (text.after_colon, "A: b: c", "b: c"),
        (text.dash_parts, " 12 S -", ["12", "S"]),
        (text.canonical_code, "P.E-133/26", "PE-133/26"),
        (values.clock, "10:30 H", "10:30"),
        (values.clock, "a continuación", "A continuación"),
        (values.date_or_null, "31/02/2026", "31/02/2026"),
        (values.leading_int, "S/T", None),
        (values.month_number, "Septiembre", "09"),
        (extract.case_codes, "S-289/26, PE-98/26, P.E-133/26", ["S-289/26", "PE-98/26", "PE-133/26"]),
    ],
)
def test_golden(spark, function, cell, want):
    assert one(spark, function, cell) == want


@pytest.mark.parametrize("function", [text.title_particles, text.title_each])
def test_very_long_words_keep_their_tail(spark, function):
    df = spark.createDataFrame([("B" * ((1 << 20) + 9),)], "c string")
    assert df.select(F.length(function(F.col("c"))).alias("n")).first().n == (1 << 20) + 9


def test_structs(spark):
    assert tuple(one(spark, values.law_and_date, "27818 - 24/06/2026")) == ("27818", "24/06/2026")
    assert tuple(one(spark, values.law_and_date, " - ")) == (None, None)
    assert tuple(one(spark, values.order_number, "275/2026 (N)")) == (275, 2026, "NORMAL")
    assert tuple(one(spark, lambda c: values.order_number(c, F.lit("2026-05-01").cast("timestamp")), "x")) == (5, 2026, "NORMAL")
    assert tuple(one(spark, extract.case_link, "http://x/verExp/574.26/S/PD"))[:4] == (574, 2026, "S", "PD")
    assert tuple(one(spark, extract.hyperlink, '=HYPERLINK("u","t")')) == ("u", "t")


def test_fold_and_squash_match_python(spark):
    rng = random.Random(3)
    cells = ["".join(rng.choice("aéñÑüÇ \t\n oß") for _ in range(20)) for _ in range(200)]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for row in df.select("c", text.fold(F.col("c")).alias("f"), text.squash(F.col("c")).alias("s")).collect():
        assert row.f == "".join(x for x in unicodedata.normalize("NFD", row.c) if unicodedata.category(x) != "Mn")
        assert row.s == " ".join(row.c.split())


def test_decree(spark):
    decree = "Artículo 1°- Desígnase a los señores Senadores Ana María PAZ y Luis SOL en la Comisión de Salud, en reemplazo de los señores Senadores Juan ROJO, respectivamente. Artículo 2°- Comuníquese."
    (change,) = one(spark, extract.decree_changes, decree)
    assert (change.body, change.designated, change.replaced) == ("Salud", ["Ana María PAZ", "Luis SOL"], ["Juan ROJO"])
