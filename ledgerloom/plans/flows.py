"""Whole flows over landed frames. Storage stays outside: frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import roster_key, squash, surname_first, surname_key
from ledgerloom.functions.values import found, leading_int, meeting_kind
from ledgerloom.operators import extract, lookup, merge, ordered
from ledgerloom.plans import workbook
from ledgerloom.sources import commits


def incremental_records(known: DataFrame, found: DataFrame, details: DataFrame, keys: list[str], order: list[str], columns: list[str], as_of) -> DataFrame:
    """known with the details of open records latched, and new records added.

    found: listed records; details: what their pages say, by key. Records that have
    details are stamped with as_of as reviewed, changed or not; so are new ones.
    """
    seen = details.select(*keys, F.lit(True).alias("__seen")).distinct()
    latched = merge.upsert_latch(known, details, keys, columns).drop("changed").join(seen, keys, "left")
    reviewed = latched.withColumn("reviewed", F.when(F.col("__seen"), as_of).otherwise(F.col("reviewed"))).drop("__seen")
    new = merge.first_wins(merge.only_new(found, known, keys), keys, order).join(details, keys, "left").withColumn("reviewed", as_of)
    return reviewed.unionByName(new, allowMissingColumns=True)


def approved_import(known: DataFrame, rows: DataFrame, cells: str, order: str, labels: dict[str, str], columns: list[str]) -> DataFrame:
    """known records (number, year, kind and others) after rows of approved ones were read
    in their order, which is unique; outcome says what happened, the latest record comes first.

    Rows of any kind count, those without one don't. A known record takes the listed
    columns of the last row of its key, nulls too; an unknown one is the first row of its
    key with these columns of the last. A number or year that isn't one is a null, and
    nulls are equal here.
    """
    keys = ["number", "year", "kind"]
    told = workbook.approved_records(rows, cells, labels)
    kept = [c for c in known.columns if c not in keys and c not in columns and c in told.columns]
    first = F.min_by(F.struct(*kept, F.lit(0).alias("__none")), order).alias("__first")
    last = F.max_by(F.struct(*columns), order).alias("__last")
    new = told.groupBy(*keys).agg(first, last).select(*keys, *(F.col(f"__first.{c}") for c in kept), *(F.col(f"__last.{c}") for c in columns))
    return merge.upsert_overwrite(known, new, keys, columns).orderBy(F.desc("year"), F.desc("number"), "kind")


def newest_listed(listed: DataFrame, done: DataFrame, id_col: str, after: int | None, keys: list[str]) -> DataFrame:
    """Of the rows above ``after`` that aren't done, as taken by ascending id, the one that
    remains of each key: that of the largest id."""
    return merge.last_wins(merge.past_watermark(listed, done, id_col, after), keys, [id_col])


def reviewed_agreements(known: DataFrame | None, records: DataFrame, details: DataFrame, kind: str = "AC") -> DataFrame:
    """Agreements (number, year, title, origin, entry, announced, announced_on, approved,
    approved_on, order) after records (number, year, kind, title, origin) of their kind
    were looked at; details: number, year, entry, announced, announced_on of their pages.

    The number before the entry's slash and a known announcement, with its date,
    overwrite; approvals and orders of known agreements stay. A record without an
    agreement gets one that is neither announced, unless its page says so, nor approved.
    null known: there are none yet.
    """
    told = details.select("number", "year", found(F.col("entry"), r"^(\d+)(?:/|$)").try_cast("int").alias("entry"), "announced", "announced_on")
    seen = merge.first_wins(records.where(F.col("kind") == kind).select("number", "year", "title", "origin"), ["number", "year"], ["title", "origin"]).join(merge.first_wins(told, ["number", "year"], ["entry", "announced", "announced_on"]), ["number", "year"], "left")
    fresh = seen.withColumns({"approved": F.lit(False), "approved_on": F.lit(None).cast("string"), "order": F.lit(None).cast("int")})
    started = fresh.withColumn("announced", F.coalesce("announced", F.lit(False)))
    if known is None:
        return started
    kept = merge.upsert_partial(known, fresh, ["number", "year"], ["entry"], {"announced": ["announced_on"]})
    return kept.withColumn("announced", F.coalesce("announced", F.lit(False)))


def commit_review(spark: SparkSession, path: str, records: DataFrame, agreements: DataFrame, done: DataFrame, base: int | None = None, dry_run: bool = False) -> int | None:
    """Records and agreements, sorted, and the ids that are done now become current
    together, or none of them does. base: the version that they were made from."""
    by = [F.desc("year"), F.desc("number")]
    return commits.commit(spark, path, {"records": records.orderBy(*by), "agreements": agreements.orderBy(*by)}, {"state": done}, base, dry_run)


def full_reload(rows: DataFrame, kinds: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of known kinds, the first of each key, the latest years and numbers first."""
    kept = merge.first_wins(rows.where(F.col("tipo").isin(*kinds)), keys, order)
    return kept.orderBy(F.desc("anio"), F.desc("nro"), *order)


def agenda_log(rows: DataFrame, by: str, order: str, cells: str) -> DataFrame:
    """Meetings of tabular bulletins from landed rows (by, order, section, cells): by,
    meeting_no (from 1), section, day, date, time, mode, bodies, room, full_room, agenda
    and kind.

    A row whose cells name a date and a time is a header; the places of its columns hold
    until the next one, in whatever order and with whatever cells between. The first row
    after it that has a clock time in the time column is the meeting, in the header's
    section; the first cells of later rows are its agenda. Columns that a header doesn't
    name are empty; rows before a header or without cells don't count.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    places = extract.column_map(F.col(cells))
    marked = rows.where(F.size(cells) > 0).withColumn("__p", places)
    header = F.col("__p.date").isNotNull() & F.col("__p.time").isNotNull()
    carried = marked.select(
        by, F.col(order).alias("__o"), F.col(cells).alias("__c"), header.alias("__h"), F.sum(header.cast("int")).over(w).alias("meeting_no"),
        F.last(F.when(header, F.struct("__p", "section")), ignorenulls=True).over(w).alias("__m"),
    ).where("meeting_no > 0 AND NOT __h")
    cell = lambda name: F.coalesce(F.get(F.col("__c"), F.col(f"__m.__p.{name}")), F.lit(""))
    time, first = squash(cell("time")), F.get(F.col("__c"), F.lit(0))
    item = F.when(~squash(first).isin("") & (F.upper(squash(first)) != "TEMARIO"), first)
    read = carried.select(
        by, "meeting_no", "__o", F.col("__m.section").alias("section"), F.when(time.rlike(r"^\d{1,2}:\d{2}$"), time).alias("time"), item.alias("__item"),
        extract.day_cell(cell("date")).alias("__d"), extract.body_cell(cell("body")).alias("__b"), extract.room_cell(cell("room")).alias("__r"),
    )
    row = F.struct("__o", "section", "time", "__d", "__b", "__r")
    found = read.groupBy(by, "meeting_no").agg(F.min(F.when(F.col("time").isNotNull(), row)).alias("__m"), F.array_sort(F.collect_list(F.when(F.col("__item").isNotNull(), F.struct("__o", "__item")))).alias("__i")).where("__m IS NOT NULL")
    later = F.filter("__i", lambda i: i["__o"] > F.col("__m.__o"))
    agenda = F.array_join(F.transform(later, lambda i: i["__item"]), "\n")
    number = F.row_number().over(Window.partitionBy(by).orderBy("meeting_no"))
    return found.select(
        by, number.alias("meeting_no"), "__m.section", "__m.__d.day", "__m.__d.date", "__m.time", "__m.__b.mode", "__m.__b.bodies", "__m.__r.room", F.col("__m.__r.full").alias("full_room"),
        extract.agenda_items(agenda).alias("agenda"), meeting_kind(F.col("__m.section"), F.col("__m.__b.bodies")).alias("kind"),
    )


def session_header(cells: Column) -> Column:
    """The section that a row of a session's bulletin begins, null for rows that begin none."""
    first = F.upper(F.get(cells, F.lit(0)))
    acuerdos = F.array(*map(F.lit, ("OD", "ACUERDOS CONSIDERADOS", "RESULTADO", "OBSERVACIONES")))
    return F.when(cells == acuerdos, "acuerdo").when(first.startswith("MOCIONES DE PREFERENCIA"), "preferencia").when(first == "PROYECTOS DE LEY", "ley").when(first.startswith("PROYECTOS DE DECRETO"), "decreto_res_com_dec")


def outcomes(rows: DataFrame, header, ignored) -> DataFrame:
    """Outcome items of landed session rows (bulletin, page, tbl, row, cells): sections
    carried over pages and tables, an item for each case code of the title cell, with
    order_number, result and observations.

    Rows are (order, title, result, observations), under 'preferencia' (title, result,
    observations), where only approved ones count and have no order. Shorter rows don't
    count. An order of S/T has no number.
    """
    carried = ordered.carry_section(rows, ["bulletin"], ["page", "tbl", "row"], header, ignored).where(F.col("section").isNotNull() & header.isNull())
    motion = F.col("section") == "preferencia"
    cell = lambda k: F.get(F.col("cells"), F.when(motion, k - 1).otherwise(k))
    kept = carried.where((F.size("cells") >= F.when(motion, 3).otherwise(4)) & (~motion | (F.upper(F.btrim(cell(2))) == "APROBADA")))
    number = F.when(~motion, leading_int(F.get(F.col("cells"), F.lit(0))))
    return extract.explode_codes(kept.withColumns({"text": cell(1), "order_number": number, "result": cell(2), "observations": cell(3)}), "text")


def designations(decrees: DataFrame) -> DataFrame:
    """A row for each person whom decrees (number, ord, text) designate: number, ord, article,
    pair_no, body, kind ('replace' or 'add'), designated and replaced as SURNAME, Names.
    Bicameral bodies are left out."""
    changes = decrees.select("number", "ord", F.posexplode(extract.decree_changes(F.col("text"))).alias("article", "c"))
    changes = changes.select("number", "ord", "article", F.col("c.body").alias("body"), F.col("c.designated").alias("new"), F.col("c.replaced").alias("old"))
    pairs = ordered.paired(changes.where(~F.contains(F.upper("body"), F.lit("BICAMERAL"))), "new", "old", ["number", "ord", "article", "body"])
    replaced = F.when(F.col("replaced").isNotNull(), surname_first(F.col("replaced")))
    return pairs.select(
        "number", "ord", "article", "pair_no", "body", F.when(replaced.isNull(), "add").otherwise("replace").alias("kind"),
        surname_first(F.col("designated")).alias("designated"), replaced.alias("replaced"),
    )


def roster_changes(rosters: DataFrame, decrees: DataFrame, order: str = "body", persons: DataFrame | None = None, unknown: str = "Sin datos") -> DataFrame:
    """body (of the roster), ord, article, pair_no, designated, bloc, replaced: what decrees
    (number, ord, text) change. A decree's body is the roster of the same key, else the
    first, by order, whose key contains it or is contained in it; without one its
    changes have no effect. bloc: that of the first of persons (name, bloc; by name) who
    has the designated one's surname, unknown without one; empty without persons."""
    log = designations(decrees).withColumn("__d", roster_key(F.col("body"))).where("__d <> ''").drop("body")
    keyed = rosters.withColumn("__k", roster_key(F.col("body"))).where("__k <> ''")
    bodies = lookup.containment_match(log.select("__d").distinct(), "__d", "__d", keyed.select("__k", F.col(order).alias("__o")), "__k", "__o")
    own = keyed.select("body", F.col("__k").alias("matched"))
    found = log.join(bodies, "__d").join(own, "matched")
    surname = lambda c: surname_key(F.get(F.split(c, ","), F.lit(0)))
    if persons is None:
        found = found.withColumn("bloc", F.lit(""))
    else:
        first = merge.first_wins(persons.withColumn("__s", surname(F.col("name"))), ["__s"], ["name", "bloc"]).select("__s", "bloc")
        found = found.withColumn("__s", surname(F.col("designated"))).join(first, "__s", "left").withColumn("bloc", F.coalesce("bloc", F.lit(unknown)))
    return found.select("body", "ord", "article", "pair_no", "designated", "bloc", "replaced")


def roster_after(rosters: DataFrame, decrees: DataFrame, order: str = "body", persons: DataFrame | None = None, unknown: str = "Sin datos") -> DataFrame:
    """rosters (body, members; each body once) after the ``roster_changes`` of decrees, in
    ord's order. A body's changes are folded in one row: a roster is a state."""
    change = F.struct(F.col("designated").alias("name"), "bloc", "replaced")
    one = F.struct("ord", "article", "pair_no", change.alias("change"))
    events = roster_changes(rosters, decrees, order, persons, unknown).groupBy("body").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["change"]).alias("changes"))
    joined = rosters.join(events, "body", "left")
    return joined.select("body", F.when(F.col("changes").isNull(), F.col("members")).otherwise(ordered.fold_roster(F.col("members"), F.col("changes"))).alias("members"))
