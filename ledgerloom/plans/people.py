"""The dimension of persons and the first state of rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold, person_key, strip
from ledgerloom.operators.merge import canonical_spelling, first_wins, last_wins, only_new


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def people(current: DataFrame, former: DataFrame, unknown: str) -> DataFrame:
    """name, bloc, province, current of rows of current (ord, bloc, surname, given, province)
    and of former (ord, name, district, bloc) persons.

    Of current rows of a name the last counts, of former ones the first, and only if no
    current one has the name. Blocs that differ in case or accents take the spelling
    met first, current rows first; a bloc that isn't given is unknown. Rows without a
    surname or name are left out. Provinces of former persons become upper case.
    """
    bloc = strip(F.when(_or_empty(F.col("bloc")) == "", unknown).otherwise(F.col("bloc"))).alias("raw")
    given = F.when(_or_empty(F.col("given")) != "", F.concat(F.lit(", "), "given")).otherwise("")
    now = current.where(_or_empty(F.col("surname")) != "").select(F.lit(0).alias("tier"), "ord", person_key(F.concat("surname", given)).alias("name"), bloc, strip(_or_empty(F.col("province"))).alias("province"))
    before = former.where(_or_empty(F.col("name")) != "").select(F.lit(1).alias("tier"), "ord", person_key(F.col("name")).alias("name"), bloc, F.upper(strip(_or_empty(F.col("district")))).alias("province"))
    both = now.unionByName(first_wins(only_new(before, now, ["name"]), ["name"], ["ord"]))
    spelt = canonical_spelling(both, "raw", F.upper(fold(F.col("raw"))), ["tier", "ord"], "", "bloc")
    return last_wins(spelt, ["name"], ["ord"]).select("name", "bloc", "province", (F.col("tier") == 0).alias("current"))


def with_roles(rosters: DataFrame, members: str = "members", default: str = "") -> DataFrame:
    """rosters whose members all have a role, default where it is missing."""
    return rosters.withColumn(members, F.transform(members, lambda m: m.withField("role", F.coalesce(m["role"], F.lit(default)))))
