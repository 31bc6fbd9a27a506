"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.operators import analytics, extract, geometry, lookup, merge, ordered
from ledgerloom.plans import dayorders, flows, people, views, workbook
from ledgerloom.sources import commits, landing, listings, tables, text_index, workbooks
from ledgerloom.sources.shared import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Register a function of frames under a name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def cols(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def dealt(df: DataFrame, *names: str) -> DataFrame:
    """The columns, dealt out by the first: reading a page costs far more than moving what
    it is made of, and a file of one row group would be one task."""
    return df.select(*names).repartition(3 * df.sparkSession.sparkContext.defaultParallelism, names[0])


joined = lambda c: F.array_join(c, "|")

# ---- dedup, merge, state


@query("flagship", """
    WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) WHERE n = 1)
    SELECT n_name, count(*) AS n FROM f JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10""", "orders", "customer", "nation")
def _(orders, customer, nation):
    first = merge.first_wins(cols(orders, "o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    at = first.join(cols(customer, "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return at.groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name").limit(10)


_FIRST = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {0}) n FROM events) WHERE n = 1"


@query("d1_first_wins_dedupe", _FIRST.format("ts, event_id"), "events")
def _(events):
    return merge.first_wins(cols(events, "user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("d2_last_wins_first_pos", """
    SELECT user_id, event_type, event_id, value, place FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS place,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1""", "events")
def _(events):
    placed = cols(events, "user_id", "event_type", "event_id", "value", "ts").withColumn("place", F.col("event_id"))
    return merge.last_wins(placed, ["user_id", "event_type"], ["ts", "event_id"], "place").drop("ts")


@query("d3_priority_union", """
    WITH c AS (SELECT c_nationkey AS nation, c_name AS name, c_custkey AS ord FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1),
    s AS (SELECT s_nationkey AS nation, s_name AS name, s_suppkey AS ord FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1)
    SELECT * FROM c UNION ALL SELECT * FROM s WHERE nation NOT IN (SELECT nation FROM c)""", "customer", "supplier")
def _(customer, supplier):
    a = customer.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    b = supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return merge.priority_union(a, b, ["nation"], ["ord"])


@query("d4_append_union", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier", "customer", "supplier")
def _(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).unionByName(supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("m6_anti_incremental", "SELECT event_id, user_id FROM events e WHERE event_id > 500 AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 7 = 0 AND d.event_id = e.event_id)", "events")
def _(events):
    return merge.past_watermark(cols(events, "event_id", "user_id"), events.where("event_id % 7 = 0").select("event_id"), "event_id", 500)


@query("m5_baseline_marking", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'applied' ELSE 'baseline' END AS status FROM events", "events")
def _(events):
    return merge.baseline(cols(events, "event_id"), events.where("event_id % 3 = 0").select("event_id", F.lit("applied").alias("status")), ["event_id"])


_UPDATE = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 10 <> 1),
    n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'X' END AS st, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS price FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 4 = 0) """


def _old_new(orders):
    k, price = F.col("o_orderkey"), F.round("o_totalprice", 2)
    old = orders.where(k % 10 != 1).select(k.alias("k"), F.col("o_orderstatus").alias("st"), price.alias("price"))
    status = F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise("X")
    new = orders.where((k % 2 == 1) | (k % 4 == 0)).select(k.alias("k"), status.alias("st"), F.when(k % 3 == 0, 0.0).otherwise(price).alias("price"))
    return old, new


@query("m2_upsert_overwrite", _UPDATE + """
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.st ELSE o.st END AS st, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price,
    CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.st IS DISTINCT FROM n.st OR o.price IS DISTINCT FROM n.price THEN 'updated' ELSE 'unchanged' END AS outcome
    FROM o FULL JOIN n ON o.k = n.k""", "orders")
def _(orders):
    return merge.upsert_overwrite(*_old_new(orders), ["k"], ["st", "price"])


@query("a4_merge_outcomes", _UPDATE + """
    , m AS (SELECT CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.st IS DISTINCT FROM n.st OR o.price IS DISTINCT FROM n.price THEN 'updated' ELSE 'unchanged' END AS outcome
    FROM o FULL JOIN n ON o.k = n.k) SELECT outcome, count(*) AS n FROM m GROUP BY outcome""", "orders")
def _(orders):
    return merge.upsert_overwrite(*_old_new(orders), ["k"], ["st", "price"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("m1_upsert_latch", _UPDATE + """
    SELECT o.k, CASE WHEN n.st <> '' THEN n.st ELSE o.st END AS st, CASE WHEN n.price <> 0 THEN n.price ELSE o.price END AS price,
    coalesce(n.st <> '' AND n.st IS DISTINCT FROM o.st, false) AS changed FROM o LEFT JOIN n ON o.k = n.k""", "orders")
def _(orders):
    return merge.upsert_latch(*_old_new(orders), ["k"], ["st", "price"], silent=("price",))


@query("m3_upsert_partial", _UPDATE + """
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.st IS NOT NULL THEN n.st ELSE o.st END AS st, CASE WHEN n.st IS NOT NULL THEN n.price ELSE o.price END AS price
    FROM o FULL JOIN n ON o.k = n.k""", "orders")
def _(orders):
    return merge.upsert_partial(*_old_new(orders), ["k"], [], {"st": ["price"]})


@query("o1_stable_sort_topk", "SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders ORDER BY y DESC, o_custkey DESC, o_orderkey LIMIT 100", "orders")
def _(orders):
    return analytics.sort_recent(orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), ["y", "o_custkey"], ["o_orderkey"]).limit(100)


@query("k3_state_ids", "SELECT array_to_string(list_sort(list(DISTINCT user_id::VARCHAR)), '|') AS processed FROM events", "events")
def _(events):
    from ledgerloom.sources.sinks import state_rows

    return state_rows(events, "user_id").select(joined(F.col("processed")).alias("processed"))


# ---- ordered state

_CARRY = "last_value(CASE event_type WHEN 'signup' THEN 'S' || event_id WHEN 'error' THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("w1_section_carry", f"SELECT event_id, user_id, nullif({_CARRY}, '') AS section FROM events", "events")
def _(events):
    kind = F.col("event_type")
    header = F.when(kind == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string")))
    return cols(ordered.carry_section(cols(events, "event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], header, kind == "error"), "event_id", "user_id", "section")


@query("w2_section_carry_initial", f"SELECT event_id, user_id, nullif(coalesce({_CARRY}, 'first'), '') AS section FROM events", "events")
def _(events):
    kind = F.col("event_type")
    header = F.when(kind == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string")))
    return cols(ordered.carry_section(cols(events, "event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], header, kind == "error", "first"), "event_id", "user_id", "section")


@query("w3_header_sessionize", """
    WITH g AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS group_no FROM events),
    d AS (SELECT *, min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id, group_no) AS first_order FROM g WHERE group_no > 0 AND event_type <> 'signup')
    SELECT user_id, group_no::BIGINT AS group_no, first_order, coalesce(string_agg(CASE WHEN event_id > first_order THEN event_type END, '|' ORDER BY event_id), '') AS items
    FROM d WHERE first_order IS NOT NULL GROUP BY ALL""", "events")
def _(events):
    kind = F.col("event_type")
    found = ordered.sessionize(cols(events, "user_id", "event_id", "event_type"), ["user_id"], ["event_id"], kind == "signup", kind == "view", kind)
    return found.withColumn("items", joined(F.transform("items", lambda i: i["item"])))


@query("w5_lookahead_two", """
    SELECT event_id, CASE WHEN a = 'purchase' THEN true WHEN a = 'error' THEN false WHEN b = 'purchase' THEN true ELSE false END AS followed
    FROM (SELECT event_id, lead(event_type, 1) OVER w AS a, lead(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""", "events")
def _(events):
    kind = F.col("event_type")
    return cols(ordered.follows_within(cols(events, "event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], kind == "purchase", kind == "error"), "event_id", "followed")


@query("w7_retraction_suspend", """
    WITH l AS (SELECT event_id, day(ts) AS bid, (user_id % 7)::VARCHAR AS scope, event_type FROM events),
    k AS (SELECT *, max(bid) OVER (PARTITION BY scope, event_type) AS seen, max(bid) OVER (PARTITION BY scope) AS latest,
          row_number() OVER (PARTITION BY scope, event_type ORDER BY bid DESC, event_id DESC) AS n FROM l)
    SELECT scope, event_type, event_id, latest > seen AS suspended FROM k WHERE n = 1""", "events")
def _(events):
    log = events.select("event_id", F.day("ts").alias("bid"), (F.col("user_id") % 7).cast("string").alias("scope"), "event_type")
    return cols(ordered.current_state(log, "bid", "scope", ["scope", "event_type"], ["event_id"]), "scope", "event_type", "event_id", "suspended")


@query("w9_positional_zip", """
    WITH a AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey) AS new, list(o_orderkey + 1 ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0) AS old FROM orders GROUP BY 1)
    SELECT c, (i - 1)::INT AS pair_no, new[i] AS designated, old[i] AS replaced FROM (SELECT *, unnest(range(1, len(new) + 1)) AS i FROM a)""", "orders")
def _(orders):
    k = F.col("o_orderkey")
    grouped = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(k)).alias("new"), F.array_sort(F.collect_list(F.when(k % 3 == 0, k + 1))).alias("old"))
    return ordered.paired(grouped, "new", "old", ["c"])


@query("w10_staleness_topk", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS reviewed FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus <> 'F' AND NOT (o_orderstatus = 'P' AND c_acctbal > 0) ORDER BY reviewed NULLS FIRST, o_orderkey LIMIT 200""", "orders", "customer")
def _(orders, customer):
    known = customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("settled"))
    own = cols(orders, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").withColumn("reviewed", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")))
    open_ = ordered.open_records(own, known, ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", "settled")
    return cols(ordered.stalest(open_, "reviewed", ["o_orderkey"], 200), "o_orderkey", "reviewed")


@query("w8_role_fold", None, "orders", "lineitem")
def _(orders, lineitem):
    """Rosters of customers, whose members are their orders, after replacements by their
    lines; compared with a Python model in the tests."""
    name = F.concat(F.lit("S"), F.col("o_orderkey").cast("string"), F.lit(", X"))
    member = F.struct("o_orderkey", F.struct(name.alias("name"), F.col("o_orderpriority").alias("bloc"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("role")).alias("m"))
    rosters = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    change = F.struct(F.concat(F.lit("T"), (F.col("l_partkey") % 50).cast("string"), F.lit(", Y")).alias("name"), F.lit("").alias("bloc"), F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("replaced"))
    event = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", change.alias("c"))
    lines = lineitem.join(cols(orders, "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    changes = lines.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(event)), lambda x: x["c"]).alias("changes"))
    after = rosters.join(changes, "o_custkey", "left").withColumn("members", F.when(F.col("changes").isNull(), F.col("members")).otherwise(ordered.fold_roster(F.col("members"), F.col("changes"))))
    return after.select("o_custkey", joined(F.transform("members", lambda m: F.concat_ws(":", m["name"], m["role"]))).alias("members"))


# ---- lookups and joins


@query("j1_two_tier_lookup", """
    WITH f AS (SELECT c_nationkey, c_name FROM customer WHERE c_custkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
    SELECT o_orderkey, coalesce(e.c_name, f.c_name, 'none') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) e ON o_custkey = e.c_custkey
    LEFT JOIN f ON o_custkey % 30 = f.c_nationkey""", "orders", "customer")
def _(orders, customer):
    dim = customer.where("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", "c_name")
    return lookup.two_tier(cols(orders, "o_orderkey", "o_custkey"), dim, (F.col("o_custkey"), "c_custkey"), (F.col("o_custkey") % 30, "c_nationkey"), ["c_custkey"], "c_name", "none").drop("o_custkey")


@query("j2_enrich_left_coalesce", "SELECT doc_id, lang, coalesce(quality, -1) AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id)", "documents", "labels")
def _(documents, labels):
    return lookup.enrich(cols(documents, "doc_id", "lang"), labels, ["doc_id"], ["quality", "toxic"], {"quality": -1})


@query("j6_containment_match", """
    WITH n(name, ord) AS (VALUES ('a', 1), ('red', 2), ('blue', 3), ('part', 4), ('e', 5)),
    m AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_name <> name), ord) AS r FROM part JOIN n ON contains(p_name, name) OR contains(name, p_name))
    SELECT p.p_partkey, name AS matched FROM part p LEFT JOIN m ON m.p_partkey = p.p_partkey AND r = 1""", "part")
def _(part):
    names = part.sparkSession.createDataFrame([("a", 1), ("red", 2), ("blue", 3), ("part", 4), ("e", 5)], "name string, ord int")
    return lookup.containment_match(cols(part, "p_partkey", "p_name"), "p_partkey", "p_name", F.broadcast(names), "name", "ord").drop("p_name")


@query("j8_semi_known", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", "customer", "supplier")
def _(customer, supplier):
    return lookup.known_only(cols(customer, "c_custkey", "c_nationkey"), F.col("c_nationkey"), supplier.where("s_acctbal > 5000"), "s_nationkey").drop("c_nationkey")


@query("j11_attach_arrays", """
    SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, '|' ORDER BY l_linenumber, l_returnflag), '') AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "orders", "lineitem")
def _(orders, lineitem):
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    found = analytics.attach(cols(orders, "o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_returnflag"], ["l_linenumber"], "lines")
    return found.withColumn("lines", joined(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"]))))


@query("c10_attribute_list", """
    WITH x AS (SELECT o_custkey, n_name, min(o_orderkey) AS p FROM orders JOIN supplier ON s_suppkey = o_orderkey % 40 JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
    SELECT c_custkey, coalesce(string_agg(n_name, '|' ORDER BY p), '') AS nations FROM customer LEFT JOIN x ON o_custkey = c_custkey GROUP BY c_custkey""", "customer", "orders", "supplier", "nation")
def _(customer, orders, supplier, nation):
    dim = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    listed = analytics.ordered_collect(orders.withColumn("s", F.col("o_orderkey") % 40), ["o_custkey"], ["o_orderkey"], "s", "names")
    own = customer.select("c_custkey").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("names", F.coalesce("names", F.array().cast("array<bigint>")))
    return lookup.attribute_list(own, "c_custkey", "names", dim, "s_suppkey", "n_name", None).select("c_custkey", joined(F.col("values")).alias("nations"))


@query("q7_next_event", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE ts >= TIMESTAMP '2024-01-15') WHERE n = 1", "events")
def _(events):
    return cols(lookup.next_event(cols(events, "user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"], F.lit("2024-01-15").cast("timestamp_ntz")), "user_id", "event_id")


# ---- text and values


@query("n1_accent_fold", "SELECT doc_id, strip_accents(text) AS folded FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("n2_ws_collapse", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS squashed FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", text.squash(F.col("text")).alias("squashed"))


@query("n3_body_key", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('DE ' || upper(p_type), '^DE ', ''), '[^A-Z0-9, ]', '', 'g'), ' +', ' ', 'g')) AS k FROM part", "part")
def _(part):
    return part.select("p_partkey", text.body_key(F.concat(F.lit("de "), F.col("p_type"))).alias("k"))


@query("n6_person_key", "SELECT c_custkey, upper(trim(split_part(c_name, '#', 1)) || ', ' || trim(split_part(c_name, '#', 2))) AS k FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", text.person_key(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" ,  ")), F.lit(" "))).alias("k"))


@query("n7_canon_spelling", """
    WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS raw FROM part),
    f AS (SELECT lower(raw) AS k, arg_min(raw, p_partkey) AS canon FROM s WHERE raw <> '' GROUP BY 1)
    SELECT p_partkey, CASE WHEN raw = '' THEN 'none' ELSE canon END AS canon FROM s LEFT JOIN f ON lower(raw) = k""", "part")
def _(part):
    k = F.col("p_partkey")
    own = part.select("p_partkey", F.when(k % 3 == 0, F.upper("p_brand")).when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("raw"))
    return cols(merge.canonical_spelling(own, "raw", text.folded_upper(F.col("raw")), ["p_partkey"], "none", "canon"), "p_partkey", "canon")


@query("n8_title_case_particles", """
    SELECT p_partkey, array_to_string(list_transform(string_split(p_type || ' de la ' || p_name, ' '), lambda w, i: CASE WHEN i > 1 AND upper(w) IN ('DE','DEL','LA','LOS','LAS','Y','E')
    THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS t FROM part""", "part")
def _(part):
    return part.select("p_partkey", text.title_particles(F.concat_ws(" ", "p_type", F.lit("de la"), "p_name")).alias("t"))


@query("n10_sentence_case", """
    WITH w AS (SELECT p_partkey, string_split(lower(p_type || '. de ' || p_name || ' para ' || p_brand), ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN (i > 1 AND NOT regexp_matches(w[i - 1], '[.!?]$')) AND upper(x) IN ('DE', 'PARA', 'LA', 'Y', 'EN', 'CON', 'A') THEN x
    ELSE regexp_extract(x, '^[^a-z]*') || upper(regexp_extract(x, '^[^a-z]*([a-z]?)', 1)) || substr(x, length(regexp_extract(x, '^[^a-z]*([a-z]?)')) + 1) END), ' ') AS t FROM w""", "part")
def _(part):
    return part.select("p_partkey", text.sentence_case(F.concat(F.col("p_type"), F.lit(". de "), F.col("p_name"), F.lit(" para "), F.col("p_brand"))).alias("t"))


@query("n12_surname_suffix", """
    WITH w AS (SELECT p_partkey, [upper(p_name[1]) || lower(p_name[2:])] AS given, CASE p_partkey % 4 WHEN 0 THEN [upper(p_type)] WHEN 1 THEN ['GOERLING', 'LARA'] WHEN 2 THEN ['de', 'ZAMORA'] ELSE ['Lopez'] END AS rest
              FROM (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z].*', '') AS p_name, regexp_replace(p_type, '[^A-Za-z].*', '') AS p_type FROM part))
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'ZAMORA, ' || given[1] || ' De' ELSE array_to_string(rest, ' ') || ', ' || given[1] END AS formatted FROM w""", "part")
def _(part):
    k, word = F.col("p_partkey"), lambda c: F.regexp_replace(c, "[^A-Za-z].*", "")
    rest = F.when(k % 4 == 0, F.upper(word("p_type"))).when(k % 4 == 1, "GOERLING LARA").when(k % 4 == 2, "de ZAMORA").otherwise("Lopez")
    given = F.concat(F.lower(F.substring(word("p_name"), 1, 1)), F.lower(F.substring(word("p_name"), F.lit(2), F.length("p_name"))))
    return part.select("p_partkey", text.surname_first(F.concat_ws(" ", given, rest)).alias("formatted"))


@query("n13_referrals", """
    SELECT p_partkey, 'De ' || upper(p_brand[1]) || lower(p_brand[2:]) || '|De Y Z' AS r FROM part""".replace("De Y Z", "De y Z"), "part")
def _(part):
    return part.select("p_partkey", joined(text.referrals(F.concat(F.lit("DE "), F.upper("p_brand"), F.lit(" - DE Y Z - DE "), F.upper("p_brand"), F.lit(" -")))).alias("r"))


@query("n17_prefix_all_match", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'NADIE Y ' || upper(p_brand) || ': ' || p_name END AS title FROM part""", "part")
def _(part):
    k, brand = F.col("p_partkey"), F.upper("p_brand")
    title = F.concat(F.when(k % 2 == 0, brand).otherwise(F.concat(F.lit("NADIE Y "), brand)), F.lit(": "), F.col("p_name"))
    return part.select("p_partkey", text.without_author_prefix(title, F.array(F.concat(brand, F.lit(", JUAN")), F.lit("OTRA, ANA"))).alias("title"))


@query("n18_extract_parts", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_partkey % 3 = 0 THEN 'MENSAJE ' || p_brand || ': ' || p_name ELSE p_name END AS description FROM part""", "part")
def _(part):
    c = F.concat(F.when(F.col("p_partkey") % 3 == 0, "MENSAJE ").otherwise(""), F.col("p_brand"), F.lit(": "), F.col("p_name"))
    return part.select("p_partkey", text.extract_parts(c).alias("e")).select("p_partkey", "e.author", "e.description")


@query("n19_record_url", "SELECT o_orderkey, 'x/' || o_orderkey || '.' || right(year(o_orderdate)::VARCHAR, 2) || '/S/' || o_orderstatus AS url, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE o_orderstatus END AS label FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", text.record_url("x", F.col("o_orderkey"), F.year("o_orderdate"), F.lit("S"), F.col("o_orderstatus")).alias("url"), text.labelled(F.col("o_orderstatus"), {"O": "Open", "F": "Finished"}).alias("label"))


@query("c1_year_expand", """
    SELECT o_orderkey, year(o_orderdate)::INT % 100 + 2000 AS by_length, 2000 + year(o_orderdate)::INT AS always, year(o_orderdate)::INT % 100 + 2000 AS by_size FROM orders""", "orders")
def _(orders):
    y = F.year("o_orderdate").cast("string")
    return orders.select("o_orderkey", values.year_by_length(F.right(y, F.lit(2))).alias("by_length"), values.year_always(y).alias("always"), values.year_by_size(F.right(y, F.lit(2))).alias("by_size"))


@query("c2_date_normalise", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS slashed, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""", "orders")
def _(orders):
    c = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("el "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" fin"))).otherwise("SIN FECHA")
    return orders.select("o_orderkey", values.slashed_date(c).alias("slashed"), values.as_date(values.slashed_date(c)).alias("day"))


@query("c4_law_and_date", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END AS law, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS law_date,
    o_orderkey::INT AS number, 2026 AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'ANEXO' ELSE 'NORMAL' END AS kind FROM orders""", "orders")
def _(orders):
    k = F.col("o_orderkey").cast("string")
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    cell = F.when(n % 2 == 0, F.concat(k, F.lit(" - "), day)).when(n % 3 == 0, F.concat(F.lit("ABC - "), day)).when(n % 5 == 0, day).otherwise(" - ")
    number = F.concat(k, F.when(F.col("o_orderkey") % 3 == 0, "/26 (A)").otherwise("/2026 (N)"))
    found = orders.select("o_orderkey", values.law_and_date(cell).alias("l"), values.order_number(number).alias("n"))
    return found.select("o_orderkey", F.col("l.number").alias("law"), F.col("l.date").alias("law_date"), "n.number", "n.year", "n.kind")


@query("n4_roster_key", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'DELA ' ELSE '' END || upper(p_name || ' ' || p_type) AS k FROM part", "part")
def _(part):
    lead = F.element_at(F.array(*map(F.lit, ("De ", "de la ", "DE LOS ", "dé las ", "dela "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select("p_partkey", text.roster_key(F.concat(lead, F.col("p_name"), F.lit("  "), F.col("p_type"))).alias("k"))


@query("n5_surname_key", "SELECT p_partkey, 'NANDU ' || upper(p_brand) AS k FROM part", "part")
def _(part):
    return part.select("p_partkey", text.surname_key(F.concat(F.lit(" Ñandú  "), F.col("p_brand"))).alias("k"))


@query("n11_title_each", """
    SELECT p_partkey, 'D' || chr(39) || upper(p_brand[1]) || lower(p_brand[2:]) || '-' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t FROM part""", "part")
def _(part):
    return part.select("p_partkey", text.title_each(F.concat(F.lit("d'"), F.lower("p_brand"), F.lit("-"), F.upper("p_name"))).alias("t"))


@query("n14_dash_parts", "SELECT o_orderkey, o_orderstatus || '|AP|' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '-' END AS parts FROM orders", "orders")
def _(orders):
    k = F.col("o_orderkey")
    return orders.select("o_orderkey", joined(text.dash_parts(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("  AP "), k.cast("string"), F.when(k % 2 == 0, " - ").otherwise("--")))).alias("parts"))


@query("n15_author_list", "SELECT c_custkey, upper(c_name) || ', X|' || upper(c_mktsegment) || ', B  B' AS authors FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", joined(text.author_list(F.concat(F.col("c_name"), F.lit(" ,  x - "), F.col("c_mktsegment"), F.lit(",  B  b - - ")))).alias("authors"))


@query("n16_after_colon", "SELECT p_partkey, p_name || ': z' AS t FROM part", "part")
def _(part):
    return part.select("p_partkey", text.after_colon(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"), F.lit(": z"))).otherwise(F.concat(F.lit(" :"), F.col("p_name"), F.lit(": z ")))).alias("t"))


@query("n20_signers", "SELECT c_custkey, c_name || '|' || c_mktsegment || '|A-B' AS names FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", joined(text.signers(F.concat(F.lit(" "), F.col("c_name"), F.lit(".. - "), F.col("c_mktsegment"), F.lit(".  –  A-B")))).alias("names"))


@query("n21_origin_label", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Executive' WHEN 1 THEN 'Cd' ELSE 'Ov' END AS origin, CASE o_orderkey % 3 WHEN 0 THEN 'AC' ELSE '' END AS kind FROM orders", "orders")
def _(orders):
    k = F.col("o_orderkey")
    code = F.concat(F.when(k % 3 == 0, "p.e-").when(k % 3 == 1, "CD-").otherwise("OV-"), k.cast("string"), F.when(k % 3 == 0, "/25-ac").otherwise("/25"))
    return orders.select("o_orderkey", text.code_origin(code, {"PE": "Executive"}).alias("origin"), text.code_kind(code).alias("kind"))


@query("c3_date_full_match", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '31/02/2026' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders", "orders")
def _(orders):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    return orders.select("o_orderkey", values.date_or_null(F.when(k % 3 == 0, "31/02/2026").when(k % 3 == 1, F.concat(F.lit(" "), day)).otherwise(F.concat(F.lit("el "), day))).alias("day"))


@query("c6_numbers", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::INT END AS number, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '/26' END AS bulletin,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%m') END AS month FROM orders""", "orders")
def _(orders):
    k = F.col("o_orderkey")
    even = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    slashed = F.concat(k.cast("string"), F.lit("/26"))
    bulletin = even(F.concat(F.lit("Boletín N° "), slashed), F.concat(F.repeat(F.lit("x"), F.lit(200)), F.lit("N° "), slashed))
    month = F.when(k % 7 == 0, "nada").otherwise(F.element_at(F.array(*(F.lit(m.lower()) for m in values.MONTHS)), F.month("o_orderdate")))
    return orders.select("o_orderkey", values.leading_int(even(slashed, F.lit("S/T"))).alias("number"), values.bulletin_number(bulletin).alias("bulletin"), values.month_number(month).alias("month"))


@query("c8_clock", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN 'A continuación' ELSE 'TARDE' END AS time FROM events", "events")
def _(events):
    k = F.col("event_id")
    return events.select("event_id", values.clock(F.when(k % 3 == 0, F.concat(F.date_format("ts", "HH:mm"), F.lit(" h"))).when(k % 3 == 1, "a continuación").otherwise(" tarde ")).alias("time"))


@query("c11_main_authors", """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'UNO, A|ZZZ, B' WHEN 1 THEN 'ZZZ, B' WHEN 2 THEN 'UNO, A' ELSE 'UNO, A|ZZZ, B' END AS main,
    CASE c_custkey % 4 WHEN 1 THEN 'UNO, A' WHEN 2 THEN 'ZZZ, B' ELSE '' END AS others FROM customer""", "customer")
def _(customer):
    """No mark; a mark after a name; a mark without a name; a mark after the colon."""
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, "ZZZ: ley").when(k % 4 == 1, "Zzz y otros: ley").when(k % 4 == 2, "Y OTRAS: ley").otherwise(F.concat(F.lit("ZZZ: ley y otros de "), "c_name"))
    both = F.array(F.lit("UNO, A"), F.lit("ZZZ, B"))
    return customer.select("c_custkey", text.main_authors(title, both).alias("a")).select("c_custkey", joined(F.col("a.main")).alias("main"), joined(F.col("a.others")).alias("others"))


@query("c12_flags", """
    SELECT o_orderkey, o_orderstatus = 'F' AS archived, o_orderkey % 5 = 0 AS lapsed, o_orderstatus = 'P' AND o_orderkey % 7 > 0 AS enacted,
    o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS approved, CASE WHEN o_orderkey % 3 = 0 THEN 'bicameral' ELSE 'senadores' END AS kind FROM orders""", "orders")
def _(orders):
    k, st, day = F.col("o_orderkey"), F.col("o_orderstatus"), F.date_format("o_orderdate", "dd/MM/yyyy")
    flags = values.status_flags(F.when(st == "F", day), F.when(k % 5 == 0, day), F.when(st == "P", F.when(k % 7 == 0, "").otherwise(k.cast("string"))))
    passed = values.approved(F.when(st == "O", "AP/26").otherwise("no"), F.when(k % 2 == 0, "AP"))
    bodies = F.array(F.lit("Salud"), F.when(k % 3 == 0, "Bicameral de X").otherwise("Y"))
    return orders.select("o_orderkey", flags.alias("f"), passed.alias("approved"), values.meeting_kind(F.lit("senadores"), bodies).alias("kind")).select("o_orderkey", "f.*", "approved", "kind")


# ---- extraction


@query("x1_html_links", """
    SELECT page_id, (i - 1)::INT AS pos, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS h FROM pages))""", "pages")
def _(pages):
    return extract.links(cols(pages, "page_id", "html"), "page_id", "html")


@query("x2_html_cells", """
    SELECT p_partkey, (i - 1)::INT AS row_no, CASE i WHEN 1 THEN p_brand || '|' || p_size ELSE p_name || '|' || p_type END AS cells FROM part, range(1, 3) t(i)""", "part")
def _(part):
    row = lambda *c: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td> <b>"), x, F.lit("</b></td>")) for x in c), F.lit("</tr>"))
    size = F.col("p_size").cast("string")
    page = F.concat(F.lit("<table>"), row(size), F.lit("</table><table class='x'>"), row(F.col("p_brand"), size), row(F.col("p_name"), F.col("p_type")), F.lit("<tr><td>one</td></tr></table>"))
    found = extract.table_rows(part.select("p_partkey", page.alias("html")), "p_partkey", extract.largest_table(F.col("html")), 2)
    return found.select("p_partkey", "row_no", joined(F.col("cells")).alias("cells"))


@query("x3_case_links", "SELECT o_orderkey, o_orderkey::INT AS number, year(o_orderdate)::INT % 100 + 2000 AS year, 'PE' AS origin, 'AC' AS kind FROM orders", "orders")
def _(orders):
    href = F.concat(F.lit("/x/verExp/"), F.col("o_orderkey").cast("string"), F.lit("."), F.right(F.year("o_orderdate").cast("string"), F.lit(2)), F.lit("/P.E/AC"))
    return orders.select("o_orderkey", extract.case_link(href).alias("c")).select("o_orderkey", "c.number", "c.year", "c.origin", "c.kind")


@query("x13_codes_explode", """
    SELECT o_orderkey, unnest(['S-' || o_orderkey || '/26', 'PE-' || o_orderkey || '/25']) AS code FROM orders WHERE o_orderkey % 3 > 0""", "orders")
def _(orders):
    k = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Exp. S-"), k, F.lit("/26 y P.E-"), k, F.lit("/25."))).otherwise("nada")
    return extract.explode_codes(orders.select("o_orderkey", line.alias("line")), "line").drop("line")


@query("x11_agenda_items", "SELECT o_orderkey, 'S-' || o_orderkey || '/26=uno|CD-1/25=dos' AS items FROM orders", "orders")
def _(orders):
    c = F.concat(F.lit("PROYECTOS: EXPTE. S- "), F.col("o_orderkey").cast("string"), F.lit("/26: uno\n  EXPTE.CD-1/25 - dos"))
    return orders.select("o_orderkey", joined(F.transform(extract.agenda_items(c), lambda i: F.concat_ws("=", i["number"], i["extract"]))).alias("items"))


@query("x12_free_agenda_items", "SELECT o_orderkey, '=Plan general|S-' || o_orderkey || '/26=uno|P.E-1/25=dos' AS items FROM orders", "orders")
def _(orders):
    c = F.concat(F.lit("Plan general: S-"), F.col("o_orderkey").cast("string"), F.lit("/26 uno. PROYECTO DE LEY: P.E-1/25: dos."))
    return orders.select("o_orderkey", joined(F.transform(extract.free_agenda_items(c), lambda i: F.concat_ws("=", i["number"], i["extract"]))).alias("items"))


@query("x4_table_by_summary", "SELECT p_partkey, p_brand || '|' || p_name AS cells FROM part WHERE p_partkey % 2 = 0", "part")
def _(part):
    row = F.concat(F.lit("<tr><td>"), F.col("p_brand"), F.lit("</td><td><a href='x'>"), F.col("p_name"), F.lit("</a></td></tr>"))
    summary = F.when(F.col("p_partkey") % 4 == 0, "Giros del").when(F.col("p_partkey") % 2 == 0, "GIROS DEL").otherwise("Fechas del")
    page = F.concat(F.lit("<table summary='otra'><tr><td>a</td><td>b</td></tr></table><table border='1' summary='"), summary, F.lit(" expediente'>"), row, F.lit("</table>"))
    found = extract.table_rows(part.select("p_partkey", page.alias("html")), "p_partkey", extract.table_by_summary(F.col("html"), "Giros"), 2)
    return found.select("p_partkey", joined(F.col("cells")).alias("cells"))


@query("x7_three_state", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS known, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders""", "orders")
def _(orders):
    """A date; none; a longer header; no row; a row without the cell."""
    k = F.col("o_orderkey")
    header = F.when(k % 5 == 2, "Fecha Dado Cuenta").otherwise("Dado Cuenta")
    cell = F.when(k % 5 == 1, "SIN FECHA").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    body = F.when(k % 5 == 3, "").when(k % 5 == 4, "<tr><td>1</td></tr>").otherwise(F.concat(F.lit("<tr><td>1</td><td>"), cell, F.lit("</td></tr>")))
    page = F.concat(F.lit("<table><thead><tr><th>Nro</th><th>"), header, F.lit("</th></tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    return orders.select("o_orderkey", extract.three_state(page, "DADO CUENTA").alias("s")).select("o_orderkey", "s.known", F.col("s.date").alias("day"))


@query("x8_record_page", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'PAZ, Ana|' || o_orderpriority ELSE '' END AS authors, CASE WHEN o_orderkey % 3 = 0 THEN 'DE SALUD|DE ' || o_orderstatus ELSE '' END AS bodies,
    CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '/2026' WHEN 1 THEN '7/2025' ELSE '' END AS entry,
    o_orderkey % 4 IN (0, 1) AS archived, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS archived_on, o_orderkey % 4 = 1 AS lapsed, CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') END AS lapsed_on,
    o_orderkey % 5 < 2 AS enacted, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey::VARCHAR END AS law, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS law_date,
    CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS announced, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS announced_on FROM orders""", "orders")
def _(orders):
    """Pages with and without each part; a law with a date, without one, and a date without a law."""
    orders = dealt(orders, "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    k, day, cust = F.col("o_orderkey"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.col("o_custkey").cast("string")
    row = lambda *c: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *c), F.lit("</td></tr>"))
    table = lambda summary, head, *rows: F.concat(F.lit(f"<table summary='{summary}'><thead><tr>{head}</tr></thead><tbody>"), *rows, F.lit("</tbody></table>"))
    people = F.concat(F.lit("<a href='/senadores/senador/1' title=' PAZ, Ana '>x</a><a href='/senadores/senador/2'><b>"), F.col("o_orderpriority"), F.lit("</b></a><a href='/otro'>no</a>"))
    bodies = table("Giros del Expediente a Comisiones", "<th>Giro</th>", row(F.lit("DE SALUD ORDEN DE GIRO: 1"), day), row(F.concat(F.lit("DE "), "o_orderstatus", F.lit(" ORDEN DE GIRO: 2"))), row(F.lit("ORDEN DE GIRO: 3")))
    desk = table("Fechas en Mesa de Entradas", "<th>Mesa</th><th>Dado Cuenta</th>", row(day, F.when(k % 3 == 0, day).otherwise("SIN FECHA")))
    law = table("Sancion de Ley", "", F.when(k % 5 != 1, row(F.concat(F.lit("FECHA DE SANCION: "), day))).otherwise(""), F.when(k % 5 < 2, row(F.concat(F.lit("NUMERO DE LEY: "), cust))).otherwise(""))
    page = F.concat(
        F.when(k % 2 == 0, people).otherwise(""), F.when(k % 3 == 0, bodies).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("<p>D.A.E. "), k.cast("string"), F.lit("/2026</p>"))).when(k % 3 == 1, "<p>7/2025 Tipo: NORMAL</p>").otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit("<p>Enviado al archivo : "), day)).when(k % 4 == 1, F.concat(F.lit("<p>EL EXPEDIENTE CADUCO EL "), day)).otherwise(""), F.when(k % 3 < 2, desk).otherwise(""), F.when(k % 5 < 3, law).otherwise(""),
    )
    found = orders.select("o_orderkey", extract.record_page(page).alias("p")).select("o_orderkey", "p.*")
    return found.withColumns({"authors": joined(F.col("authors")), "bodies": joined(F.col("bodies"))})


@query("x10_header_and_cells", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0,1,2,3' WHEN 1 THEN '1,2,0,' ELSE ',0,,1' END AS places, o_orderkey % 3 < 2 AS is_header, CASE WHEN o_orderkey % 2 = 0 THEN 'MARTES' ELSE '' END AS day,
    CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%d/%m') ELSE '' END AS date, 'SALUD|' || o_orderstatus AS bodies, CASE WHEN o_orderkey % 2 = 0 THEN 'Mixta' ELSE '' END AS mode, 'Azul' AS room, 'Azul Piso ' || o_orderkey AS full FROM orders""", "orders")
def _(orders):
    k = F.col("o_orderkey")
    a = lambda *x: F.array(*(F.lit(v) for v in x))
    header = F.when(k % 3 == 0, a("FECHA", "Hora", "COMISIÓN Y FECHA DE", "Salón")).when(k % 3 == 1, a("Comisión", "Fecha", "fecha y hora", "HORA")).otherwise(a("HORA", "SALON", None, ""))
    at = extract.column_map(header)
    date = F.concat(F.lit(" "), F.when(k % 2 == 0, "Martes\n").otherwise(""), F.when(k % 4 < 2, F.date_format("o_orderdate", "dd/MM")).otherwise("mañana"))
    bodies = F.concat(F.lit("SALUD\n\n"), F.col("o_orderstatus"), F.when(k % 2 == 0, "\n( Mixta )").otherwise(""))
    cells = orders.select("o_orderkey", at.alias("m"), extract.day_cell(date).alias("d"), extract.body_cell(bodies).alias("b"), extract.room_cell(F.concat(F.lit("Azul\n Piso  "), k.cast("string"))).alias("r"))
    places = F.concat_ws(",", *(F.coalesce(F.col(f"m.{n}").cast("string"), F.lit("")) for n in ("date", "time", "body", "room")))
    return cells.select("o_orderkey", places.alias("places"), (F.col("m.date").isNotNull() & F.col("m.time").isNotNull()).alias("is_header"), "d.day", "d.date", joined(F.col("b.bodies")).alias("bodies"), "b.mode", "r.room", "r.full")


@query("x19_workbook_records", """
    SELECT o_orderkey, o_orderkey::INT AS number, 2026 AS year, CASE o_orderkey % 3 WHEN 0 THEN 'AC' ELSE 'PL' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'Agreement' ELSE 'Bill' END AS kind_label,
    'ley ' || o_orderpriority AS extract, CASE o_orderkey % 2 WHEN 0 THEN 'PAZ, ANA' ELSE 'PAZ, ANA|ROJO, LUIS' END AS authors, CASE o_orderkey % 2 WHEN 0 THEN 'ROJO, LUIS' ELSE '' END AS coauthors, 'SALUD|' || o_orderstatus AS bodies,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '' END AS date, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_custkey || '/2026' END AS entry, 'S' AS origin, 'u/' || o_orderkey AS url,
    o_orderkey % 4 = 0 AS enacted, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::VARCHAR END AS law, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS law_date,
    o_orderkey % 4 IN (1, 2) AS archived, CASE o_orderkey % 4 WHEN 1 THEN '01/02/2026' WHEN 2 THEN '03/04/2026' END AS archived_on, o_orderkey % 4 = 3 AS lapsed, CASE o_orderkey % 4 WHEN 3 THEN '05/06/2026' END AS lapsed_on
    FROM orders WHERE o_orderkey % 3 < 2""", "orders")
def _(orders):
    """Agreements, bills and an unknown kind; archived by either column, lapsed, enacted or with a date alone."""
    return workbook.records(orders.select("o_orderkey", _workbook_row().alias("cells")), "cells", {"AC": "Agreement", "PL": "Bill"}).withColumns({c: joined(F.col(c)) for c in ("authors", "coauthors", "bodies")})


def _workbook_row():
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    number, cust = k.cast("string"), F.col("o_custkey").cast("string")
    own = {
        0: F.lit(" S "), 1: F.concat(F.lit('=HYPERLINK("n","'), number, F.lit('")')), 2: F.concat(F.lit('=HYPERLINK("u/'), number, F.lit('","2026")')), 3: F.when(k % 3 == 0, "AC").when(k % 3 == 1, "PL").otherwise("??"),
        4: F.concat(F.when(k % 2 == 0, "Paz y otros: ley ").otherwise("ley "), "o_orderpriority"), 5: F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, F.concat(cust, F.lit(" "), day, F.lit(" -"))).otherwise(F.concat(cust, F.lit(" -"))),
        6: F.when(k % 4 == 3, "05/06/2026"), 7: F.when(k % 4 == 2, " 03/04/2026").when(k % 4 == 1, "09/09/2026"), 8: F.when(k % 2 == 0, F.concat(day, F.lit(" -"))).otherwise("pronto -"), 13: F.lit("Paz, Ana - ROJO, Luis - "),
        15: F.lit(" SALUD"), 19: F.lit(" "), 31: F.col("o_orderstatus"), 34: F.when(k % 6 == 0, F.concat(F.lit('=HYPERLINK("o","'), number, F.lit(' 26 AP -")'))).when(k % 6 == 3, F.concat(number, F.lit(" 26 PE"))),
        35: F.when(k % 4 == 0, F.concat(F.lit("AP "), day)).otherwise("AP"), 36: F.when(k % 4 == 0, F.concat(cust, F.lit(" - "), day)).when(k % 4 == 1, F.concat(F.lit("S/N - "), day)).otherwise(" - "), 38: F.when(k % 4 == 1, "01/02/2026"),
    }
    return F.array(*(own.get(at, F.lit(None)).cast("string") for at in range(39)))


@query("x20_workbook_agreements", """
    SELECT o_orderkey, o_orderkey::INT AS number, 2026 AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'Paz y otros: ley ' ELSE 'ley ' END || o_orderpriority AS title, 'S' AS origin, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey::INT END AS entry,
    o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 AS announced, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS announced_on,
    o_orderkey % 6 = 0 AS approved, CASE WHEN o_orderkey % 12 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS approved_on, o_orderkey::INT AS "order" FROM orders WHERE o_orderkey % 3 = 0""", "orders")
def _(orders):
    return workbook.agreements(orders.select("o_orderkey", _workbook_row().alias("cells")), "cells")


@query("x14_session_outcomes", """
    WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row, l_partkey FROM lineitem),
    m AS (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 'preferencia' WHEN 1 THEN 'ley' WHEN 2 THEN '-' END AS mark FROM l),
    s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY row ROWS UNBOUNDED PRECEDING) AS section FROM m)
    SELECT l_orderkey, row, section, unnest(['S-' || l_partkey || '/26', 'PE-' || row || '/25']) AS code, CASE WHEN section = 'ley' AND l_partkey % 2 = 0 THEN l_partkey::INT END AS order_number,
           CASE l_partkey % 7 WHEN 6 THEN 'RECHAZADA' ELSE ' Aprobada' END AS result, 'APROBADA' AS observations
    FROM s WHERE mark IS NULL AND section <> '-' AND l_partkey % 7 <> 3 AND (section <> 'preferencia' OR l_partkey % 7 <> 6)""", "lineitem")
def _(lineitem):
    """Headers, ignored headers, rows that are too short and, under motions, rejected ones."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind, part = F.col("l_partkey") % 7, F.col("l_partkey").cast("string")
    rows = lineitem.select("l_orderkey", "l_partkey", F.row_number().over(w).alias("row"))
    mark = F.when(kind == 0, "preferencia").when(kind == 1, "ley").when(kind == 2, "-")
    section = F.last(mark, ignorenulls=True).over(Window.partitionBy("l_orderkey").orderBy("row"))
    title = F.concat(F.lit("Exp. S-"), part, F.lit("/26 y P.E-"), F.col("row").cast("string"), F.lit("/25"))
    own = F.array(title, F.when(kind == 6, "RECHAZADA").otherwise(" Aprobada"), F.when(kind == 3, F.lit(None)).otherwise("APROBADA"))
    whole = F.when(section == "preferencia", own).otherwise(F.concat(F.array(F.when(F.col("l_partkey") % 2 == 0, part).otherwise(" s/t")), own))
    cells = F.when(kind == 0, F.array(F.lit("MOCIONES DE PREFERENCIA DE"))).when(kind == 1, F.array(F.lit("Proyectos de ley"))).when(kind == 2, F.array(F.lit("Cambio de giro"))).otherwise(F.filter(whole, lambda c: c.isNotNull()))
    landed = rows.select(F.col("l_orderkey").alias("bulletin"), F.lit(0).alias("page"), F.lit(0).alias("tbl"), "row", cells.alias("cells"))
    first = F.upper(F.get(F.col("cells"), F.lit(0)))
    found = flows.outcomes(landed, flows.session_header(F.col("cells")), first.startswith("CAMBIO DE GIRO"))
    return found.select(F.col("bulletin").alias("l_orderkey"), "row", "section", "code", "order_number", "result", "observations")


_LINES = {0: "🗓 MARTES 3 DE MARZO 🕑 10:30 H 📍 SALÓN AZUL", 1: "AGENDA DE ASESORES", 2: "NO HAY REUNIONES", 3: "SALUD", 4: "EXPOSITORES: x", 5: "📋 TEMARIO", 6: "texto S-1/26.", 7: "*SE ACTUALIZARÁ", 8: "UNA ESPECIAL | OTRA"}


@query("w4_free_text_meetings", r"""
    WITH l AS (SELECT l_orderkey AS b, row_number() OVER w AS o, l_partkey % 9 AS k, lead(l_partkey % 9) OVER w AS k1, lead(l_partkey % 9, 2) OVER w AS k2
               FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    n AS (SELECT *, CASE k WHEN 0 THEN 'd' WHEN 1 THEN 's' WHEN 2 THEN 'n' WHEN 3 THEN 'm' WHEN 4 THEN 'p' WHEN 5 THEN 'x' WHEN 6 THEN 't' WHEN 7 THEN 'u'
                 ELSE CASE WHEN k1 = 0 OR (k1 NOT IN (5, 6) AND k2 = 0) THEN 'm' ELSE 't' END END AS e FROM l),
    e AS (SELECT *, coalesce(last_value(CASE WHEN e IN ('d', 's', 'n', 'u', 'm') THEN e END IGNORE NULLS) OVER (PARTITION BY b ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'd' AS open FROM n),
    g AS (SELECT *, sum((e = 'd')::INT) OVER (PARTITION BY b ORDER BY o) AS meeting,
                 sum((e IN ('s', 'n') OR (e = 'm' AND open))::INT) OVER (PARTITION BY b ORDER BY o) + sum((e = 'd')::INT) OVER (PARTITION BY b ORDER BY o) - (e = 'd')::INT AS wait,
                 max(CASE WHEN e = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY o) AS advisers,
                 coalesce(last_value(CASE WHEN e IN ('d', 's', 'n') OR (e = 'm' AND open) THEN 0 WHEN e = 'p' THEN 1 END IGNORE NULLS) OVER (PARTITION BY b ORDER BY o), 0) AS talk FROM e),
    t AS (SELECT b, wait, string_agg(CASE WHEN k = 3 THEN 'SALUD' WHEN k = 8 THEN 'UNA ESPECIAL | OTRA' ELSE 'texto S-1/26.' END, ' ' ORDER BY o) AS line, count(*) AS n FROM g WHERE e IN ('m', 't') AND (NOT open OR e = 'm') GROUP BY ALL),
    a AS (SELECT b, meeting, string_agg(CASE WHEN k = 6 THEN 'S' ELSE 'U' END, '' ORDER BY o) AS said FROM g WHERE e = 't' AND open AND talk = 0 GROUP BY ALL)
    SELECT g.b AS l_orderkey, g.meeting::BIGINT AS meeting_no, CASE advisers WHEN 1 THEN 'asesores' ELSE 'senadores' END AS section, 'MARTES' AS day, '03/03' AS date, '10:30' AS time, 'AZUL' AS room,
           coalesce(CASE WHEN line LIKE '%|%' THEN regexp_replace(line, '\s*\|\s*', '|', 'g') ELSE replace(replace(line, 'SALUD ', 'SALUD|'), '. ', '.|') END, '') AS bodies,
           coalesce(length(replace(said, 'U', '')), 0)::INT AS coded
    FROM g LEFT JOIN t USING (b, wait) LEFT JOIN a USING (b, meeting) WHERE e = 'd'""", "lineitem")
def _(lineitem):
    """An order is a bulletin; its lines are of nine kinds."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = F.create_map(*(F.lit(x) for kv in _LINES.items() for x in kv))[(F.col("l_partkey") % 9).cast("int")]
    found = ordered.free_text_meetings(lineitem.select("l_orderkey", F.row_number().over(w).alias("o"), line.alias("line")), "l_orderkey", "o", "line", ["SALUD"])
    coded = F.size(F.filter("agenda", lambda i: i["number"] == "S-1/26"))
    return found.select("l_orderkey", "meeting_no", "section", "day", "date", "time", "room", joined(F.col("bodies")).alias("bodies"), coded.alias("coded"))


@query("x9_room_and_mode", "SELECT o_orderkey, o_orderstatus || ' A' AS room, CASE WHEN o_orderkey % 2 = 0 THEN 'virtual' ELSE '' END AS mode FROM orders", "orders")
def _(orders):
    c = F.concat(F.col("o_orderstatus"), F.lit(" \n\n A"), F.when(F.col("o_orderkey") % 2 == 0, " (virtual)").otherwise(""))
    return orders.select("o_orderkey", extract.room_and_mode(F.array_join(extract.multi_line_cell(c), " ")).alias("r")).select("o_orderkey", "r.room", "r.mode")


@query("x15_designations", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'replace' ELSE 'add' END AS kind, 'PAZ, Ana ' || p_partkey AS designated, CASE WHEN p_partkey % 2 = 0 THEN 'ROJO, Juan' END AS replaced FROM part""", "part")
def _(part):
    k = F.col("p_partkey")
    new = F.concat(F.lit("Artículo 1°- Desígnase a la señora Senadora Ana "), k.cast("string"), F.lit(" PAZ en la Comisión de Salud"))
    decrees = part.select(k.alias("number"), k.alias("ord"), F.concat(new, F.when(k % 2 == 0, ", en reemplazo del señor Senador Juan ROJO.").otherwise(".")).alias("text"))
    return flows.designations(decrees).select(F.col("number").alias("p_partkey"), "kind", "designated", "replaced")


@query("x18_hyperlinks", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'u/' || o_orderkey ELSE '' END AS url, o_orderkey::VARCHAR AS text FROM orders", "orders")
def _(orders):
    k = F.col("o_orderkey").cast("string")
    c = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('=HYPERLINK("u/'), k, F.lit('", "'), k, F.lit('")'))).otherwise(k)
    return orders.select("o_orderkey", extract.hyperlink(c).alias("h")).select("o_orderkey", "h.url", "h.text")


@query("s5_json_lenient", r"""SELECT event_id, (regexp_replace(regexp_replace(props, '\}', ',}', 'g'), ',\s*([}\]])', '\1', 'g')::JSON ->> 'k')::INT AS k FROM events""", "events")
def _(events):
    return events.select("event_id", extract.lenient_json(F.regexp_replace("props", r"\}", ",}"), "k int").alias("j")).select("event_id", "j.k")


@query("x21_group_columns", """
    SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END, NULL, o_custkey::VARCHAR], lambda x: x IS NOT NULL AND x <> ''), '|') AS a FROM orders""", "orders")
def _(orders):
    own = orders.select("o_orderkey", F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("b"), F.lit(None).cast("string").alias("c"), F.col("o_custkey").cast("string").alias("d"))
    return own.select("o_orderkey", joined(extract.group_columns("a", "b", "c", "d")).alias("a"))


@query("x22_format_dispatch", "SELECT doc_id, CASE WHEN contains(text, 'the') AND contains(text, '.') THEN 'free' ELSE 'tabular' END AS form FROM documents", "documents")
def _(documents):
    free, tabular = extract.dispatch(cols(documents, "doc_id", "text"), "text", ("the", "."))
    return free.select("doc_id", F.lit("free").alias("form")).unionByName(tabular.select("doc_id", F.lit("tabular").alias("form")))


# ---- analytics


@query("a1_cond_counts", "SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity >= 25) AS large FROM lineitem GROUP BY l_returnflag", "lineitem")
def _(lineitem):
    return analytics.conditional_counts(lineitem, {"discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") >= 25}, ["l_returnflag"])


@query("a2_group_counts_seeded", "SELECT n_nationkey AS s_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1", "supplier", "nation")
def _(supplier, nation):
    return analytics.seeded_counts(supplier.where("s_acctbal > 8000"), "s_nationkey", nation.select(F.col("n_nationkey").alias("s_nationkey")))


@query("a3_nested_sum", "SELECT count(DISTINCT o_orderkey) AS orders, count(*) AS members FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "orders", "lineitem")
def _(orders, lineitem):
    rows = lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("m")).join(cols(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.agg(F.count("*").alias("orders"), F.sum(F.size("m")).alias("members"))


@query("a7_argmax_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) n FROM orders) WHERE n = 1", "orders")
def _(orders):
    return cols(analytics.argmax_first(orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y", ["o_orderkey"]), "o_custkey", "o_orderkey")


@query("a8_pivot_dims", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1", "orders")
def _(orders):
    return analytics.pivot(cols(orders, "o_orderpriority", "o_orderstatus"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query("a8_drilldown", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'", "orders")
def _(orders):
    return cols(analytics.drilldown(orders, {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}), "o_orderkey")


_SHARE = "SELECT {0}, count(*) AS value, round(count(*) / sum(count(*)) OVER ({1}), 4) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query("a9_share_treemap", _SHARE.format("l_returnflag, l_linestatus", ""), "lineitem")
def _(lineitem):
    return analytics.shares(lineitem, ["l_returnflag", "l_linestatus"], F.count("*"))


@query("a9_stacked", _SHARE.format("l_returnflag, l_linestatus", "PARTITION BY l_returnflag"), "lineitem")
def _(lineitem):
    return analytics.shares(lineitem, ["l_returnflag", "l_linestatus"], F.count("*"), ["l_returnflag"])


@query("a9_topk_sparkline", """
    WITH t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT o_custkey, total, year(o_orderdate)::INT AS period, count(*) AS n FROM orders JOIN t USING (o_custkey) GROUP BY ALL""", "orders")
def _(orders):
    return analytics.top_with_series(cols(orders, "o_custkey", "o_orderdate"), "o_custkey", F.year("o_orderdate"), 10)


@query("a9_monthly", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 0)::BIGINT AS total FROM orders GROUP BY 1", "orders")
def _(orders):
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"))


@query("a10_bloc_representation", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", "customer", "nation", "region")
def _(customer, nation, region):
    rows = cols(customer, "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return analytics.representation(rows, "r_name", "n_name")


@query("q1_faceted_search", """
    SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') AND year(o_orderdate) BETWEEN 1995 AND 2030
    AND contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING'""", "orders", "customer")
def _(orders, customer):
    rows = orders.join(cols(customer, "c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate")).withColumn("segments", F.array("c_mktsegment"))
    return cols(analytics.faceted(rows, {"o_orderstatus": ["O", "P"]}, {"year": (1995, 2030)}, ("c_name", "1"), {"segments": "BUILDING"}, {"segments": "BUILDING"}), "o_orderkey")


@query("q2_conditional_facet", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000", "orders")
def _(orders):
    return cols(analytics.conditional_facet(orders, ["P"], "P", "o_orderstatus", F.col("o_totalprice") > 1000), "o_orderkey")


@query("q3_categorise", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' THEN 'law' WHEN o_orderstatus = 'P' THEN 'agreement' ELSE 'other' END AS category FROM orders", "orders")
def _(orders):
    law = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F")
    return orders.select("o_orderkey", F.when(law, "law").when(F.col("o_orderstatus") == "P", "agreement").otherwise("other").alias("category"))


@query("q5_badges", """
    SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS returned, coalesce(bool_or(l_discount > 0.08), false) AS cheap, max({'o': l_linenumber, 't': l_linestatus}).t AS last_status
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "orders", "lineitem")
def _(orders, lineitem):
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus", "l_returnflag", "l_discount")
    return analytics.badges(cols(orders, "o_orderkey"), lines, "o_orderkey", {"returned": F.col("l_returnflag") == "R", "cheap": F.col("l_discount") > 0.08}, {"last_status": ("l_linestatus", "l_linenumber")})


@query("o2_numeric_or_zero_sort", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::INT ELSE 0 END AS n FROM events ORDER BY n DESC, event_id LIMIT 50", "events")
def _(events):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("S/T")
    return events.select("event_id", analytics.numeric_or_zero(raw).alias("n")).orderBy(F.desc("n"), "event_id").limit(50)


# ---- listings, orders of the day, persons and views

_PLAIN = {"PE": "Poder Ejecutivo", "S": "Senado", "CD": "Cámara de Diputados"}
_CATEGORY = {"PL": "Proyecto de Ley", "PR": "Proyecto de Resolución", "AC": "Acuerdo"}
as_text = lambda c: F.col(c).cast("string")


@query("s3_bulletin_links", """
    SELECT o_orderkey, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'N' || o_custkey ELSE '' END AS number, CASE o_orderkey % 2 WHEN 0 THEN 'http://h/x/descargarBoletinReunion/' ELSE 'b/descargarboletinreunion/' END || o_orderkey AS url FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey + 1000000, 'N' || o_custkey, 'b/descargarBoletinReunion/' || (o_orderkey + 1000000) FROM orders WHERE o_orderkey % 3 = 0""", "orders")
def _(orders):
    """Links in a row whose first cell is the number, twice in a row, in a row without cells, and outside of rows."""
    orders = dealt(orders, "o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    href = F.concat(F.when(key % 2 == 0, "http://h/x/descargarBoletinReunion/").otherwise("/descargarboletinreunion/"), as_text("o_orderkey"))
    link = F.concat(F.lit("<a class='x' href='"), href, F.lit("'>see</a>"))
    second = F.concat(F.lit('<A HREF="/descargarBoletinReunion/'), (key + 1000000).cast("string"), F.lit('"><b>2</b></a>'))
    cells = F.concat(F.lit("<tr><td> <b>N</b>\n "), as_text("o_custkey"), F.lit("</td><td>"), link, second, F.lit("<a href='/other/1'>o</a></td></tr>"))
    html = F.when(key % 3 == 0, cells).when(key % 3 == 1, F.concat(F.lit("<tr>"), link, F.lit("</tr>"))).otherwise(F.concat(F.lit("<p>"), link, F.lit("</p><a href='/y'>no</a>")))
    found = listings.bulletin_links(orders.select("o_orderkey", html.alias("html")), "o_orderkey", "html", "b")
    return found


@query("s4_decree_rows", """
    SELECT o_orderkey, 2 AS row_no, 'D' || o_custkey AS number, '01/02/2026' AS date, 'Comisión de ' || o_orderstatus AS topic, CASE o_orderkey % 2 WHEN 0 THEN 'https://h/' ELSE 'b/d/' END || o_orderkey AS url FROM orders WHERE o_orderkey % 5 < 2
    """, "orders")
def _(orders):
    """The largest table; header, short rows, rows without a number or link and pages without a table give nothing."""
    orders = dealt(orders, "o_orderkey", "o_custkey", "o_orderstatus")
    key = F.col("o_orderkey")
    href = F.concat(F.when(key % 2 == 0, "https://h/").otherwise("/d/"), as_text("o_orderkey"))
    row = lambda number, link: F.concat(F.lit("<tr><td>01/02/<i>2026</i></td><td>Comisión <b>de</b> "), "o_orderstatus", F.lit("</td><td>x</td><td> "), number, F.lit(" </td><td>"), link, F.lit("</td></tr>"))
    number, link = F.concat(F.lit("D"), as_text("o_custkey")), F.concat(F.lit("<a href='"), href, F.lit("'>pdf</a>"))
    body = F.when(key % 5 < 2, row(number, link)).when(key % 5 == 2, row(F.lit(""), link)).otherwise(row(number, F.lit("pdf")))
    page = F.concat(F.lit("<table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td><a href='/z'>5</a></td></tr></table><table><tr><th>a</th></tr><tr><td>short</td></tr>"), body, F.lit("</table>"))
    return listings.decree_rows(orders.select("o_orderkey", F.when(key % 5 == 4, "none").otherwise(page).alias("html")), "o_orderkey", "html", "b")


@query("s5_session_bulletins", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey || '' ELSE o_orderkey || '/24-x' END AS number, CASE WHEN o_orderkey % 7 = 0 THEN 'pronto' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, 'u' AS url
    FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 0 AND (o_orderkey % 7 = 0 OR year(o_orderdate) >= 1996)""", "orders")
def _(orders):
    """An unreadable date stays, earlier years and rows without number or URL go."""
    key = F.col("o_orderkey")
    number = F.when(key % 5 == 0, F.when(key % 2 == 0, " ")).when(key % 4 == 0, as_text("o_orderkey")).otherwise(F.concat(F.lit(" "), as_text("o_orderkey"), F.lit("-24-x")))
    date = F.when(key % 7 == 0, "pronto").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return listings.session_bulletins(orders.select("o_orderkey", number.alias("number"), date.alias("date"), F.when(key % 9 != 0, " u ").alias("url")), 1996)


@query("f4_decree_routing", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'sin_texto' END AS status FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0""", "orders")
def _(orders):
    """Topics with and without accents and case, those done, texts that are null, of 39 and of 40 letters."""
    key = F.col("o_orderkey")
    topic = F.when(key % 2 == 1, "Otra cosa").when(key % 4 == 0, "Integración de comisiones").otherwise("LA COMISIÓN DE SALUD")
    body = F.when(key % 3 == 0, F.lit(None)).when(key % 5 == 0, F.concat(F.lit("  "), F.repeat(F.lit("a"), 39), F.lit("\n"))).otherwise(F.repeat(F.lit("a"), 40))
    decrees = orders.select("o_orderkey", topic.alias("topic"), body.alias("text"))
    new = merge.only_new(listings.about(decrees, "topic", "comision"), orders.where(key % 7 == 0), ["o_orderkey"])
    return new.select("o_orderkey", listings.text_status(F.col("text")).alias("status"))


@query("f13_lookback_window", """
    SELECT 'days' AS w, o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' - INTERVAL 30 DAY AND DATE '1996-03-01'
    UNION ALL SELECT 'since', o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-05' AND DATE '1996-03-01'""", "orders")
def _(orders):
    """Thirty days, a fixed start, and a start that isn't a date and gives none."""
    own, day = orders.select("o_orderkey", F.to_date("o_orderdate").alias("at")), F.lit("1996-03-01").cast("date")
    some = {"days": None, "since": "05/01/1996", "never": "31/31/1996"}
    parts = [listings.in_window(own, "at", day, 30, since).select(F.lit(name).alias("w"), "o_orderkey") for name, since in some.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _landed_orders(orders):
    key = F.col("o_orderkey")
    codes = F.when(key % 4 == 0, F.concat(F.lit(" S-"), as_text("o_orderkey"), F.lit("/26-PL\nP.E.-1/25-AC"))).when(key % 4 == 1, F.concat(F.lit("P.E.-"), as_text("o_orderkey"), F.lit("/26-AC - S-1/26 "))).when(key % 4 == 3, F.concat(F.lit("XX-"), as_text("o_orderkey"), F.lit("/26")))
    said = F.when(key % 3 == 0, F.concat(F.lit("PAZ Y OTROS: SOLICITA DE "), "o_orderstatus")).when(key % 3 == 1, F.concat(F.lit(" MENSAJE: DE "), "o_orderstatus"))
    number = F.when(key % 13 == 0, F.lit(None)).when(key % 5 == 0, F.concat((key % 60).cast("string"), F.lit(".0"))).when(key % 17 == 0, "S/T").otherwise((key % 60).cast("string"))
    return orders.select(
        key.alias("ord"), F.when(key % 11 != 0, 2026).alias("period"), number.alias("number"), F.when(key % 3 == 0, " Anexo I").when(key % 3 == 1, "normal").alias("kind"), codes.alias("codes"), F.concat(F.lit("u/"), as_text("o_orderkey")).alias("codes_url"),
        said.alias("extract"), F.lit("DE SALUD - DE LA NIÑEZ Y CULTURA - DE SALUD -").alias("bodies"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), F.lit(None).cast("string").alias("file_url"),
    )


_DAY_ORDERS = """WITH d AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 5 <> 0 THEN 'S/T' ELSE (o_orderkey % 60)::VARCHAR END AS number, 2026 AS period,
    CASE o_orderkey % 3 WHEN 0 THEN 'ANEXO' ELSE 'NORMAL' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'Senado' WHEN 1 THEN 'Poder Ejecutivo' WHEN 3 THEN 'Xx' ELSE '' END AS origin,
    CASE o_orderkey % 4 WHEN 0 THEN 'Proyecto de Ley' WHEN 1 THEN 'Acuerdo' ELSE '' END AS category, CASE o_orderkey % 3 WHEN 0 THEN 'Paz y Otros' END AS author,
    CASE o_orderkey % 3 WHEN 0 THEN 'Solicita de ' || o_orderstatus WHEN 1 THEN 'Mensaje: de ' || o_orderstatus ELSE '' END AS description,
    CASE o_orderkey % 4 WHEN 0 THEN 'S-' || o_orderkey || '/26-PL@u/' || o_orderkey || '|P.E.-1/25-AC@' WHEN 1 THEN 'P.E.-' || o_orderkey || '/26-AC@u/' || o_orderkey || '|S-1/26@' WHEN 3 THEN 'XX-' || o_orderkey || '/26@u/' || o_orderkey ELSE '' END AS cases,
    'De Salud|De la Niñez y Cultura' AS bodies, strftime(o_orderdate, '%d/%m/%Y') AS date, NULL::VARCHAR AS file_url FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0),
    e AS (SELECT o_orderkey AS k, o_orderkey % 4 AS s, o_orderkey + 1 AS row, CASE WHEN o_orderkey % 19 = 0 THEN 5 ELSE o_orderkey % 60 END AS n, CASE WHEN o_orderkey % 19 = 0 THEN 3 ELSE o_orderkey % 3 END AS f, o_orderkey % 5 AS p, o_orderpriority AS b FROM orders),
    x AS (SELECT s, row, n, b, CASE f WHEN 0 THEN 'ANEXO' ELSE 'NORMAL' END AS kind, CASE WHEN p = 0 THEN '' WHEN p = 1 THEN CASE WHEN f = 1 THEN 'PAZ' ELSE 'PAZ ANEXO: LUZ|SOL' END ELSE 'PAZ|ROJO' END AS signers FROM e WHERE s < 3 AND row >= 4 AND f <> 2
          UNION ALL SELECT s, row, n, b, 'ANEXO', 'LUZ|SOL' FROM e WHERE s < 3 AND row >= 4 AND f = 1 AND p = 1),
    m AS (SELECT n::INT AS number, 2026 AS period, kind, signers, CASE WHEN s < 2 AND b <> '5-LOW' THEN b WHEN s < 2 THEN '' END AS lead FROM x QUALIFY row_number() OVER (PARTITION BY n, kind ORDER BY s DESC, row DESC) = 1) """


@query("s10_day_orders", _DAY_ORDERS + "SELECT * FROM d", "orders")
def _(orders):
    """Rows without period or number, numbers kept as 12.0, no codes, one or two, three kinds of extract."""
    return _shown(dayorders.day_orders(_landed_orders(orders), _PLAIN, _CATEGORY))


def _shown(found):
    at = F.array_join(F.transform("cases", lambda c: F.concat(c["code"], F.lit("@"), F.coalesce(c["url"], F.lit("")))), "|")
    return found.withColumns({"cases": at, "bodies": joined(F.col("bodies"))})


@query("f9_first_code_type", _DAY_ORDERS + "SELECT ord, origin, category FROM d WHERE category = 'Proyecto de Ley'", "orders")
def _(orders):
    return cols(dayorders.day_orders(_landed_orders(orders), _PLAIN, _CATEGORY, "PL"), "ord", "origin", "category")


def _landed_sheets(orders):
    key = F.col("o_orderkey")
    plain = F.concat((key % 60).cast("string"), F.when(key % 3 == 0, "/26 (a)").when(key % 3 == 1, " / 2026 y ANEXO").otherwise(" pendiente"))
    people = F.when(key % 5 == 1, "PAZ. ANEXO: LUZ – SOL.").when(key % 5 == 0, F.lit(None)).otherwise(" PAZ. - ROJO ")
    return orders.select(
        F.when(key % 4 == 0, "OD LEY").when(key % 4 == 1, "ANEXO I").when(key % 4 == 2, "OD ACUERDOS").otherwise("OTRA").alias("sheet"), (key + 1).alias("row"), plain.alias("order"),
        F.when(key % 19 == 0, F.lit("2026-05-01").cast("timestamp")).alias("typed"), F.when((key % 5 == 1) & ((key % 3 != 1) | (key % 19 == 0)), "PAZ ANEXO: LUZ – SOL.").otherwise(people).alias("signers"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("lead"),
    )


@query("s11_enrichments", _DAY_ORDERS + "SELECT * FROM m", "orders")
def _(orders):
    """Sheets in order, rows above the data, annexes in one cell, orders read as dates, unreadable ones."""
    return dayorders.enrichments(_landed_sheets(orders)).withColumn("signers", joined(F.col("signers")))


@query("j2_enriched_orders", _DAY_ORDERS + """
    SELECT ord, d.number, d.kind, category, CASE WHEN m.signers <> '' THEN m.signers END AS signers, coalesce(nullif(m.lead, ''), CASE WHEN category = 'Acuerdo' THEN 'Acuerdos' END) AS lead
    FROM d LEFT JOIN m ON try_cast(d.number AS INT) = m.number AND d.kind = m.kind""", "orders")
def _(orders):
    more = dayorders.enrichments(_landed_sheets(orders))
    found = dayorders.enriched(dayorders.day_orders(_landed_orders(orders), _PLAIN, _CATEGORY), more, "Acuerdo", "Acuerdos")
    return cols(dayorders.latest_first(found), "ord", "number", "kind", "category", "signers", "lead").withColumn("signers", joined(F.col("signers")))


@query("s12_people", """
    WITH a AS (SELECT 0 AS t, c_custkey AS o, 'PAZ, N' || c_custkey % 70 AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Sin datos' WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS raw, 'Chaco' AS province FROM customer WHERE c_custkey % 6 <> 0),
    f AS (SELECT 1 AS t, s_suppkey AS o, 'PAZ, N' || s_suppkey % 90 AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'BÚILDING' ELSE 'Unión ' || s_suppkey % 4 END AS raw, 'SALTA' AS province FROM supplier),
    g AS (SELECT * FROM f WHERE name NOT IN (SELECT name FROM a) QUALIFY row_number() OVER (PARTITION BY name ORDER BY o) = 1),
    b AS (SELECT * FROM a UNION ALL SELECT * FROM g), s AS (SELECT strip_accents(upper(raw)) AS k, arg_min(raw, t * 10000000 + o) AS bloc FROM b GROUP BY 1)
    SELECT name, bloc, province, t = 0 AS current FROM b JOIN s ON strip_accents(upper(raw)) = k QUALIFY row_number() OVER (PARTITION BY name ORDER BY o DESC) = 1""", "customer", "supplier")
def _(customer, supplier):
    """Names twice in each list and in both, blocs in two spellings or missing, rows without a surname."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    bloc = F.when(c % 7 == 0, F.when(c % 2 == 0, "")).when(c % 5 == 0, F.concat(F.col("c_mktsegment"), F.lit(" "))).otherwise(F.lower("c_mktsegment"))
    now = customer.select(c.alias("ord"), bloc.alias("bloc"), F.when(c % 6 != 0, " paz").alias("surname"), F.concat(F.lit("n"), (c % 70).cast("string"), F.lit(" ")).alias("given"), F.lit(" Chaco").alias("province"))
    names = F.concat(F.lit(" Paz ,  n"), (s % 90).cast("string"))
    before = supplier.select(s.alias("ord"), names.alias("name"), F.lit("Salta ").alias("district"), F.when(s % 2 == 0, "BÚILDING").otherwise(F.concat(F.lit("Unión "), (s % 4).cast("string"))).alias("bloc"))
    return people.people(now, before, "Sin datos")


@query("s19_default_roles", "SELECT o_orderkey, 'A:' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END || '|B:' AS members FROM orders", "orders")
def _(orders):
    key = F.col("o_orderkey")
    member = lambda name, role: F.struct(F.lit(name).alias("name"), role.cast("string").alias("role"))
    rosters = orders.select("o_orderkey", F.array(member("A", F.when(key % 2 == 0, F.col("o_orderstatus"))), member("B", F.lit(None))).alias("members"))
    return people.with_roles(rosters).withColumn("members", joined(F.transform("members", lambda m: F.concat(m["name"], F.lit(":"), m["role"]))))


@query("s7_tabular_records", """
    WITH r AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 2025 ELSE 2024 END AS year, CASE o_orderkey % 3 WHEN 0 THEN 'PL' ELSE 'AC' END AS kind, o_custkey::INT AS number FROM orders WHERE o_orderkey % 10 <> 0),
    f AS (SELECT * FROM r WHERE NOT (o_custkey % 7 = 0 AND kind = 'AC' AND year = 2024) QUALIFY row_number() OVER (PARTITION BY number, year, kind ORDER BY o_orderkey) = 1)
    SELECT number, year, kind, CASE kind WHEN 'PL' THEN 'Bill' ELSE 'AC' END AS kind_label, 'ley: ' || o_orderstatus AS extract, CASE WHEN o_orderkey % 2 = 0 THEN 'PAZ, ANA' ELSE 'PAZ, ANA|ROJO' END AS authors,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ROJO' ELSE '' END AS coauthors, 'SALUD|OBRAS' AS bodies, CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date,
    CASE o_orderkey % 3 WHEN 1 THEN '12/2026' ELSE '' END AS entry, CASE WHEN o_orderkey % 6 = 0 THEN 'S' ELSE 'CD' END AS origin, 'b/' || number || '.' || right(year::VARCHAR, 2) || '/' || CASE WHEN o_orderkey % 6 = 0 THEN 'S' ELSE 'CD' END || '/' || kind AS url FROM f""", "orders")
def _(orders):
    """Defaults for missing and blank cells, keys twice and known ones, rows without a number."""
    key = F.col("o_orderkey")
    own = orders.select(
        key.alias("ord"), F.when(key % 10 != 0, F.concat(F.lit(" "), as_text("o_custkey"))).alias("NRO"), F.when(key % 8 == 0, " ").when(key % 4 != 0, "2024 ").alias("ANIO"), F.when(key % 3 != 0, " AC").alias("TIPO"), F.when(key % 6 != 0, "CD").alias("ORIGEN"),
        F.concat(F.when(key % 2 == 0, "Paz y otros: ley: ").otherwise("x: ley: "), "o_orderstatus").alias("CARATULA"), F.when(key % 5 != 1, F.concat(F.lit("MESA "), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("MESA"),
        F.when(key % 3 == 1, "12 del 2026").when(key % 3 == 2, "DAE 12/2026").alias("DAE"), F.lit("Paz , Ana - Rojo -").alias("AUTOR"), F.lit(" ").alias("COM1"), F.lit(" SALUD").alias("COM2"), F.lit(None).cast("string").alias("COM3"), F.lit("OBRAS").alias("COM4"), F.lit("").alias("COM5"),
    )
    known = orders.where(F.col("o_custkey") % 7 == 0).select(F.col("o_custkey").cast("int").alias("number"), F.lit(2024).alias("year"), F.lit("AC").alias("kind")).distinct()
    return workbook.tabular_records(own, known, {"PL": "Bill"}, "b").withColumns({c: joined(F.col(c)) for c in ("authors", "coauthors", "bodies")})


@query("s14_section_rows", """
    WITH w AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page, l_partkey % 4 AS k, l_partkey AS p FROM lineitem),
    s AS (SELECT *, coalesce(last_value(CASE k WHEN 1 THEN 'asesores' WHEN 2 THEN 'bicameral' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page), 'senadores') AS section FROM w),
    b AS (SELECT *, coalesce(lag(section) OVER (PARTITION BY doc ORDER BY page), 'senadores') AS earlier FROM s)
    SELECT doc, page, 0 AS tbl, CASE WHEN p % 3 = 0 THEN section ELSE earlier END AS section, 0 AS row, 'a' || p AS cells FROM b UNION ALL SELECT doc, page, 1, section, 0, 'b' || p FROM b""", "lineitem")
def _(lineitem):
    """Headings in words that lie up to two units apart, a table level with or above the heading, one below, and pages without a heading."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pages = lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("page"), F.col("l_partkey").alias("p"))
    kind = F.col("p") % 4
    last = F.when(kind == 1, "Asesores").when(kind == 2, "BICAMERAL").otherwise("x")
    word = lambda top, left, text: F.struct(F.lit(top).alias("top"), F.lit(left).alias("x0"), text.alias("text"))
    said = F.array(word(50.4, 5.0, F.lit("REUNIONES")), word(51.6, 9.0, F.when(kind == 1, "de").otherwise("")), word(49.8, 20.0, last), word(54.0, 1.0, F.lit("BICAMERAL")))
    words = pages.select("doc", "page", F.inline(said)).where("text <> ''")
    first = F.when(F.col("p") % 3 == 0, 50.0).otherwise(10.0)
    table = lambda tbl, top, name: F.struct(F.lit(tbl).alias("tbl"), top.alias("top"), F.array(F.array(F.concat(F.lit(name), F.col("p").cast("string")))).alias("rows"))
    tables = pages.select("doc", "page", F.inline(F.array(table(0, first, "a"), table(1, F.lit(70.0), "b"))))
    marks = {"asesores": r"REUNIONES\s+DE\s+ASESORES", "bicameral": r"REUNIONES\s+BICAMERAL", "senadores": r"REUNIONES\s+DE\s+SENADORES"}
    return ordered.section_rows(words, tables, marks, "senadores").withColumn("cells", joined(F.col("cells")))


@query("a6_watermark", "SELECT max(event_id) AS watermark FROM events", "events")
def _(events):
    return merge.watermark(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_id")


def _records(orders):
    key = F.col("o_orderkey")
    return orders.select(F.when(key % 2 == 0, "S").otherwise("C.D.").alias("origin"), key.alias("number"), F.lit(2026).alias("year"), F.when(key % 3 == 0, "AC").otherwise("PL").alias("kind"), F.concat(F.lit("u/"), as_text("o_orderkey")).alias("url"), F.col("o_orderpriority").alias("extract"))


def _outcomes(lineitem):
    """Outcomes of the records of _records, and of some that have none."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    code = F.concat(F.when(k % 2 == 0, "S-").otherwise("CD"), F.when(n == 7, k + 9000000).otherwise(k).cast("string"), F.lit("/26"))
    note = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Ley N° 27."), n.cast("string"), F.lit("."))).when(F.col("l_returnflag") == "A", "Se comunica a la H. Cámara de Diputados")
    result = F.when(F.col("l_linestatus") == "F", " Aprobado").otherwise("RECHAZADO")
    section = F.when(n == 1, "preferencia").when(n % 3 == 2, "ley").when(n % 3 == 0, "acuerdo").otherwise("decreto_res_com_dec")
    return lineitem.select(code.alias("code"), section.alias("section"), result.alias("result"), note.alias("observations"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"))


_SECTION = "CASE WHEN l_linenumber = 1 THEN 'preferencia' WHEN l_linenumber % 3 = 2 THEN 'ley' WHEN l_linenumber % 3 = 0 THEN 'acuerdo' ELSE 'decreto_res_com_dec' END"


@query("j9_record_outcomes", """
    WITH l AS (SELECT *, l_linenumber > 1 AND l_linestatus = 'F' AS e FROM lineitem WHERE l_linenumber <> 7)
    SELECT o_orderkey AS number, coalesce(bool_or(l_linenumber = 1), false) AS preference, coalesce(bool_or(e), false) AS enacted, coalesce(bool_or(l_returnflag = 'A'), false) AS sent,
    arg_max(CASE l_returnflag WHEN 'R' THEN 'Ley N° 27.' || l_linenumber ELSE strftime(l_shipdate, '%Y-%m-%d') END, strftime(l_shipdate, '%Y-%m-%d') || l_linenumber || '-' || l_partkey || '-' || l_suppkey) FILTER (e) AS enacted_text
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "orders", "lineitem")
def _(orders, lineitem):
    return cols(views.with_outcomes(_records(orders), _outcomes(lineitem)), "number", "preference", "enacted", "sent", "enacted_text")


@query("j10_record_agreements", """
    SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS announced,
    CASE WHEN o_orderkey % 3 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'announced' WHEN 1 THEN 'pending' END END AS badge FROM orders""", "orders")
def _(orders):
    """Agreements that are announced, pending or unknown, and of the same number but another kind."""
    key = F.col("o_orderkey")
    flag = F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 1, False)
    agreed = orders.select(key.alias("number"), F.lit(2026).alias("year"), flag.alias("announced"))
    found = views.with_agreements(_records(orders), agreed.unionByName(agreed.withColumn("year", F.lit(2025))), ["announced"])
    return found.select("number", "announced", views.three_valued(F.col("announced"), "announced", "pending").alias("badge"))


@query("j12_outcome_records", f"""
    SELECT l_orderkey, l_linenumber, {_SECTION} AS section, CASE WHEN l_linenumber <> 7 THEN 'u/' || l_orderkey END AS url, CASE WHEN l_linenumber <> 7 THEN o_orderpriority END AS extract,
    CASE WHEN l_linenumber = 1 THEN 'other' WHEN l_linestatus <> 'F' THEN NULL ELSE CASE {_SECTION} WHEN 'ley' THEN 'laws' WHEN 'acuerdo' THEN 'agreements' ELSE 'other' END END AS tab
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", "orders", "lineitem")
def _(orders, lineitem):
    """Each outcome with its tab and its record, nulls where the record is unknown."""
    found = views.with_records(_outcomes(lineitem), _records(orders))
    number = F.regexp_extract("code", r"(\d+)/", 1).cast("long")
    line = F.get(F.split("ord", "-"), F.lit(0)).cast(lineitem.schema["l_linenumber"].dataType)
    return found.select(F.when(line == 7, number - 9000000).otherwise(number).alias("l_orderkey"), line.alias("l_linenumber"), "section", "url", "extract", views.outcome_tab(F.col("section"), F.col("result")).alias("tab"))


@query("q3_order_tabs", _DAY_ORDERS + """
    SELECT ord, CASE category WHEN 'Proyecto de Ley' THEN 'laws' WHEN 'Acuerdo' THEN 'agreements' ELSE 'other' END AS tab FROM d WHERE contains(number, '7') OR contains(lower(description), 'mensaje')""", "orders")
def _(orders):
    """The tabs of orders that a search by number and one by extract find."""
    found = dayorders.day_orders(_landed_orders(orders), _PLAIN, _CATEGORY)
    both = views.searched(found, "7", "number").unionByName(views.searched(found, "MENSÁJE", "description", "author")).dropDuplicates(["ord"])
    return both.select("ord", views.order_tab(F.get(F.col("cases"), F.lit(0))["code"], {"PL": "laws", "AC": "agreements"}, "other").alias("tab"))


@query("q7_agenda_views", """
    SELECT event_id, ts < TIMESTAMP '2024-01-15' AS past FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""", "events")
def _(events):
    k = F.col("event_id")
    meetings = events.select("event_id", F.col("ts").alias("date"), F.when(k % 2 == 0, "asesores").otherwise("senadores").alias("section"), F.array(F.lit("Obras"), F.when(k % 3 == 0, "Salud").otherwise("Educación")).alias("bodies"))
    return cols(views.agenda(meetings, F.lit("2024-01-15").cast("timestamp"), "EDUCACION", "asesores"), "event_id", "past")


@query("q8_histories", """
    SELECT o_orderkey, 'P' || o_custkey AS person, 'designated' AS part FROM orders UNION ALL SELECT o_orderkey, 'P' || o_custkey % 10, 'replaced' FROM orders WHERE o_orderkey % 3 = 0""", "orders")
def _(orders):
    key = F.col("o_orderkey")
    gone = F.when(key % 3 == 0, F.concat(F.lit("P"), (F.col("o_custkey") % 10).cast("string"))).when(key % 3 == 1, "")
    return views.histories(orders.select("o_orderkey", F.concat(F.lit("P"), as_text("o_custkey")).alias("designated"), gone.alias("replaced")), ["o_orderkey"])


def _small_workbook(batches):
    """A workbook of each batch of orders: a title row, then key, a link as a formula, a date."""
    import io
    import zipfile

    import pyarrow as pa

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{kinds}"><sheets><sheet name="orders" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="a" Type="{kinds}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    for batch in batches:
        rows = "".join(f'<row><c><v>{k}</v></c><c r="C9"><f>HYPERLINK("u/{k}","{k}")</f></c><c s="1"><v>{d}</v></c></row>' for k, d in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row><c><v>1</v></c></row>{rows}</sheetData></worksheet>")
        yield pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([out.getvalue()])], ["path", "content"])


@query("s8_workbook_rows", """
    SELECT o_orderkey::VARCHAR AS number, 'u/' || o_orderkey AS url, '' AS empty, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""", "orders")
def _(orders):
    """Orders written as workbooks and read back: a formula, a skipped cell, a date."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    files = orders.select("o_orderkey", days.alias("d")).mapInArrow(_small_workbook, "path string, content binary")
    cell = lambda k: F.get(F.col("cells"), F.lit(k))
    moment = F.get(F.col("typed"), F.lit(3))
    rows = workbooks.data_rows(workbooks.workbook_rows(files))
    return rows.select(cell(0).alias("number"), extract.hyperlink(cell(2))["url"].alias("url"), F.coalesce(cell(1), F.lit("")).alias("empty"), F.date_format(moment, "yyyy-MM-dd").alias("date"))


@query("s15_table_rows", """
    SELECT l_orderkey, l_linenumber, 0 AS tbl, 0 AS row, 'x y|' || l_partkey AS cells, NULL::VARCHAR AS error FROM lineitem WHERE l_partkey % 5 < 3
    UNION ALL SELECT l_orderkey, l_linenumber, 0, 1, NULL, 'row' FROM lineitem WHERE l_partkey % 5 = 2
    UNION ALL SELECT l_orderkey, l_linenumber, 1, NULL, NULL, 'table' FROM lineitem WHERE l_partkey % 5 = 1
    UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, 'page' FROM lineitem WHERE l_partkey % 5 = 3""", "lineitem")
def _(lineitem):
    """Pages with a table, with one and what isn't one, with a bad row, unreadable ones and ones without tables."""
    kind, part = F.col("l_partkey") % 5, F.col("l_partkey").cast("string")
    row = F.concat(F.lit('["x\\n y ","'), part, F.lit('"]'))
    text = F.when(kind == 0, F.concat(F.lit("[["), row, F.lit("]]"))).when(kind == 1, F.concat(F.lit("[["), row, F.lit('],"t"]'))).when(kind == 2, F.concat(F.lit("[["), row, F.lit(",7]]"))).when(kind == 3, "[[[").otherwise("[]")
    found = tables.table_rows(lineitem.select("l_orderkey", "l_linenumber", text.alias("tables")), "l_orderkey", "l_linenumber", "tables")
    return found.withColumn("cells", joined(F.col("cells")))


def streaming_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of last-wins, by micro-batches."""
    from ledgerloom.streaming.incremental import read_upserted, upsert_stream

    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value", "ts")
    source.write.parquet(f"{work}/source")
    upsert_stream(spark, f"{work}/source", source.schema, f"{work}/table", f"{work}/log", ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return read_upserted(spark, f"{work}/table", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value", F.col("__place").alias("place"))


QUERIES["streaming_incremental"] = streaming_incremental
SQL["streaming_incremental"] = SQL["d2_last_wins_first_pos"]

# ---- pages with references, nested tables and attributes of any kind


@query("x1_result_rows", """
    SELECT o_orderkey, 0 AS row_no, o_orderkey AS number, (2000 + o_custkey % 30)::INT AS year, 'PL' AS kind, 'S&Ñ' AS origin, '01/02' AS date, 'Educación ' || o_orderpriority || 'no' AS extract,
    'b/exp?n=' || o_orderkey || '&y=1' AS url, 'PEZ: Educación ' || o_orderpriority || 'no' AS title FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 2, o_custkey, 1999, 'PD', 'x', '', 'a > b', 'http://h/' || o_custkey, 'a > b' FROM orders WHERE o_orderkey % 4 < 2""", "orders")
def _(orders):
    """A row that holds a table of its own, links without quotes; rows of other kinds, without links or with few cells don't count."""
    orders = dealt(orders, "o_orderkey", "o_custkey", "o_orderpriority")
    key, cust = F.col("o_orderkey"), as_text("o_custkey")
    year = F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0")
    kind = F.when(key % 4 == 0, "PL").otherwise("XX")
    first = F.concat(F.lit("<tr><td> <a title='a > b' href=/exp?n="), as_text("o_orderkey"), F.lit("&amp;y=1><b>"), as_text("o_orderkey"), F.lit("</b>/"), year, F.lit("</a></td><td>"), kind, F.lit("</td><td>S&amp;&Ntilde;</td><td>?</td><td>01&#47;02</td><td>PEZ: Educaci&oacute;n "), F.col("o_orderpriority"), F.lit("<table><tr><td>no</table></td></tr>"))
    second = F.concat(F.lit('<TR class="r"><td><A HREF="http://h/'), cust, F.lit('">'), cust, F.lit("/1999</a><td>PD<td>x<td><td><td>a &gt; b</tr><tr><td>3/24</td><td>PL</td></tr>"))
    # Cells without end tags hold those after them, so the second row is given with them here.
    second = F.replace(F.replace(second, F.lit("</a><td>PD<td>x<td><td><td>"), F.lit("</a></td><td>PD</td><td>x</td><td/><td></td><td>")), F.lit("b</tr>"), F.lit("b</td></tr>"))
    page = F.concat(F.lit("<!-- <table><tr><tr><tr><tr><tr> --><table><tr><th>1</table><script>var t = '<table>';</script><table id=r>"), first, F.when(key % 4 < 2, second).otherwise("<tr><td>5/24</td><td>PL</td><td/><td/><td/><td>t</td></tr>"), F.lit("</table>"))
    return listings.result_rows(orders.select("o_orderkey", page.alias("html")), "o_orderkey", "html", "b", ("PL", "PD"))


@query("x2_order_rows", """
    SELECT o_orderkey, 0 AS row_no, o_orderkey::INT AS number, 2026 AS year, CASE o_orderkey % 3 WHEN 0 THEN 'A' ELSE 'N' END AS kind, 'b/od/' || o_orderkey || '?a=1&b=ñ' AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '/2025 PE PL b/verExp/' || o_custkey || '.25/P.E/PL|' ELSE '' END || '7/2024 S AC http://h/verExp/7.24/S/AC' AS cases FROM orders WHERE o_orderkey % 5 > 0""", "orders")
def _(orders):
    orders = dealt(orders, "o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    case = F.when(key % 2 == 0, F.concat(F.lit("<a href='/verExp/"), as_text("o_custkey"), F.lit(".25/P.E/PL'>x</a>"))).otherwise("<a name=y>y</a>")
    mark = F.when(key % 3 == 0, "&#40;A&rpar;").otherwise("")
    row = F.concat(F.lit("<tr><td>O.D.&nbsp;"), as_text("o_orderkey"), F.lit(" &sol; 2026 "), mark, F.lit("</td><td>"), case, F.lit('<a href="/otro">o</a> <a href="http://h/verExp/7.24/S/AC">z</a></td><td>x</td><td><a href=/od/'), as_text("o_orderkey"), F.lit("?a=1&amp;b=&ntilde;>pdf</a></td></tr>"))
    page = F.concat(F.lit("<table class='plain'><tbody><tr><td>1/1</td><td/><td/><td/></tr></tbody></table><table class=\"table table-bordered x\"><thead><tr><th>9/9</th></tr></thead><tbody>"), row, F.lit("<tr><td>sin</td><td/><td/><td/></tr></tbody></table>"))
    found = listings.order_rows(orders.select("o_orderkey", F.when(key % 5 > 0, page).otherwise("<table class=table-bordered></table>").alias("html")), "o_orderkey", "html", "b")
    shown = F.transform("cases", lambda c: F.concat(c["number"].cast("string"), F.lit("/"), c["year"].cast("string"), F.lit(" "), c["origin"], F.lit(" "), c["kind"], F.lit(" "), c["url"]))
    return found.withColumn("cases", joined(shown))


@query("x8_page_references", """
    SELECT o_orderkey, 'MUÑOZ, ' || o_orderpriority || '|Núñez & Ana' AS authors, 'DE EDUCACIÓN Y "CULTURA"|DE ' || o_orderstatus AS bodies, o_custkey || '/2026' AS entry FROM orders""", "orders")
def _(orders):
    orders = dealt(orders, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    people = F.concat(F.lit('<a title="MU&Ntilde;OZ, '), F.col("o_orderpriority"), F.lit('" href=/senadores/senador/1>x</a><a href="/senadores/senador/2?a=1&amp;b=2" title="">N&uacute;&#xF1;ez <i>&amp;</i> Ana</a>'))
    giros = F.concat(F.lit("<table><tr><td><table summary='GIROS DEL EXPEDIENTE &raquo;'><tr><th>c</th></tr><tr><td>DE EDUCACI&Oacute;N Y &quot;CULTURA&quot; ORDEN DE GIRO: 1</td><td>z</td></tr><tr><td>DE "), F.col("o_orderstatus"), F.lit("</td></tr></table></td></tr></table>"))
    page = F.concat(people, giros, F.lit("<p>D&#46;A.E.&nbsp;"), as_text("o_custkey"), F.lit("&sol;2026</p>"))
    found = orders.select("o_orderkey", extract.record_page(page).alias("p"))
    return found.select("o_orderkey", joined(F.col("p.authors")).alias("authors"), joined(F.col("p.bodies")).alias("bodies"), "p.entry")


@query("s3_s4_references", """
    SELECT o_orderkey, 'b/descargarBoletinReunion/' || o_orderkey || '?a=1&b=2' AS bulletin, 'N° ' || o_custkey AS number, 'b/d/' || o_orderkey || '?x=1&y=ñ' AS decree, 'Comisión "de" ' || o_orderstatus AS topic FROM orders""", "orders")
def _(orders):
    orders = dealt(orders, "o_orderkey", "o_custkey", "o_orderstatus")
    key = as_text("o_orderkey")
    row = F.concat(F.lit("<table><tr><td>N&deg;&#160;"), as_text("o_custkey"), F.lit("</td><td><table><tr><td></td></tr></table><a href=/descargarBoletinReunion/"), key, F.lit("?a=1&amp;b=2>see</a></td></tr></table>"))
    decree = F.concat(F.lit("<table><tr><td>1</td><td>Comisi&oacute;n &quot;de&quot; "), F.col("o_orderstatus"), F.lit("</td><td></td><td>D&#49;</td><td><a href=/d/"), key, F.lit("?x=1&amp;y=&ntilde;>pdf</a></td></tr><tr></tr><tr></tr></table>"))
    links = listings.bulletin_links(orders.select("o_orderkey", row.alias("html")), "o_orderkey", "html", "b")
    decrees = listings.decree_rows(orders.select("o_orderkey", decree.alias("html")), "o_orderkey", "html", "b")
    return links.select("o_orderkey", F.col("url").alias("bulletin"), "number").join(decrees.select("o_orderkey", F.col("url").alias("decree"), "topic"), "o_orderkey")


@query("w3_tabular_meetings", """
    SELECT o_orderkey, n::INT AS meeting_no, CASE n WHEN 1 THEN 'senadores' ELSE 'asesores' END AS section, CASE n WHEN 1 THEN 'MARTES' ELSE '' END AS day, CASE n WHEN 1 THEN '3/0' || (1 + o_orderkey % 9) ELSE '' END AS date,
    CASE n WHEN 1 THEN '9:3' || o_orderkey % 10 ELSE '17:00' END AS time, CASE n WHEN 1 THEN 'presencial' ELSE '' END AS mode,
    CASE WHEN n = 1 AND o_orderkey % 2 = 0 THEN 'SALUD|BICAMERAL ' || o_orderstatus WHEN n = 1 THEN 'SALUD|DE ' || o_orderstatus ELSE 'PAZ' END AS bodies,
    CASE WHEN n = 1 THEN 'Azul' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rojo' END AS room, CASE WHEN n = 1 THEN 'Azul piso ' || o_custkey WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rojo' END AS full_room,
    CASE n WHEN 1 THEN 'S-' || o_orderkey || '/26=uno dos|CD-2/25=18:00 tres' ELSE '=nada' END AS agenda, CASE WHEN n = 1 AND o_orderkey % 2 = 0 THEN 'bicameral' WHEN n = 1 THEN 'senadores' ELSE 'asesores' END AS kind
    FROM orders, range(1, 3) t(n)""", "orders")
def _(orders):
    """Columns in three orders, surplus ones between them, a header without a room, rows before a header, between header and meeting and after one without a time."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    last = F.concat(F.when(k % 2 == 0, "BICAMERAL ").otherwise("DE "), F.col("o_orderstatus"))
    day, time = F.concat(F.lit("Martes\n 3/0"), (k % 9 + 1).cast("string")), F.concat(F.lit(" 9:3"), (k % 10).cast("string"))
    body, room = F.concat(F.lit("SALUD\n"), last, F.lit("\n( presencial )")), F.concat(F.lit("Azul\npiso  "), as_text("o_custkey"))
    row = lambda section, *c: F.struct(F.lit(section).alias("section"), F.array(*(x if isinstance(x, Column) else F.lit(x).cast("string") for x in c)).alias("cells"))
    orders_of = (lambda d, t, b, r: (d, t, b, r), lambda d, t, b, r: (b, none, t, "", r, d), lambda d, t, b, r: (none, r, b, d, "x", t))
    lines = lambda shape, with_room: F.array(
        row("x", "3/01", "8:00", "NO", "no"), row("senadores", *shape("DÍA Y FECHA", "HORA", "COMISIÓN", "SALÓN")), row("x", "TEMARIO", "z"), row("x", *shape("", "a las 9", "", "")), row("x", *shape(day, time, body, room)),
        row("x", " temario "), row("x", F.concat(F.lit("EXPTE. S- "), as_text("o_orderkey"), F.lit("/26: uno")), "q"), row("x", none, "t"), row("x", " dos"), row("x", "EXPTE.CD-2/25 - 18:00", "18:00", "18:00", "18:00", "18:00", "18:00"), row("x", "tres"),
        row("bicameral", *shape("FECHA", "HORA", "COMISIONES", "SALON")), row("x", "never"), row("asesores", *shape("Fecha", "Hora de inicio", "Comisión", "Salon" if with_room else "")), row("x", *shape("", "17:00", "PAZ", "Rojo")), row("x", "nada"),
    )
    shaped = F.when(k % 3 == 0, lines(orders_of[0], False)).when(k % 3 == 1, lines(orders_of[1], True)).otherwise(lines(orders_of[2], True))
    landed = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.posexplode(shaped).alias("at", "r")).select("o_orderkey", "at", "r.section", "r.cells")
    found = flows.agenda_log(landed, "o_orderkey", "at", "cells")
    return found.withColumns({"bodies": joined(F.col("bodies")), "agenda": joined(F.transform("agenda", lambda i: F.concat_ws("=", i["number"], i["extract"])))})


# ---- containment of many names, all pivots, charts that filter one another


@query("j6_containment_both_ways", """
    WITH n AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN '#' || lpad((s_suppkey % 500)::VARCHAR, 4, '0') WHEN 1 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') || ' & Co' ELSE (s_suppkey % 100)::VARCHAR END AS name, s_suppkey AS ord FROM supplier),
    m AS (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_name <> name), ord, name) AS r FROM customer JOIN n ON contains(c_name, name) OR contains(name, c_name))
    SELECT c.c_custkey, name AS matched FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND r = 1""", "customer", "supplier")
def _(customer, supplier):
    """Names that are in many keys, that hold one key, and short ones."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("#"), F.lpad((k % 500).cast("string"), 4, "0"))).when(k % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" & Co"))).otherwise((k % 100).cast("string"))
    names = supplier.select(name.alias("name"), k.alias("ord"))
    return lookup.containment_match(cols(customer, "c_custkey", "c_name"), "c_custkey", "c_name", names, "name", "ord").drop("c_name")


_DIMS = {
    "status": ("o_orderstatus", None), "priority": ("o_orderpriority", None), "year": ("year(o_orderdate)", None), "month": ("month(o_orderdate)", None), "band": ("o_custkey % 5", None),
    "size": ("CASE WHEN o_totalprice > 200000 THEN 'large' END", None), "tags": (None, "CASE o_orderkey % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a', 'c', 'a'] WHEN 2 THEN []::VARCHAR[] ELSE NULL::VARCHAR[] END"),
    "blocs": (None, "[(o_custkey % 7)::VARCHAR, 'x', (o_orderkey % 2)::VARCHAR, 'x']"),
}
_LISTED = ", ".join(f"CASE WHEN len({many}) > 0 THEN {many} ELSE [NULL::VARCHAR] END AS {name}" if many else f"[({one})::VARCHAR] AS {name}" for name, (one, many) in _DIMS.items())
_PAIRS = [(a, b) for i, a in enumerate(_DIMS) for b in list(_DIMS)[i + 1 :]]


def _dims():
    k = F.col("o_orderkey")
    tags = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("c"), F.lit("a"))).when(k % 4 == 2, F.array().cast("array<string>"))
    blocs = F.array((F.col("o_custkey") % 7).cast("string"), F.lit("x"), (k % 2).cast("string"), F.lit("x"))
    plain = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "month": F.month("o_orderdate"), "band": F.col("o_custkey") % 5}
    return plain | {"size": F.when(F.col("o_totalprice") > 200000, "large"), "tags": tags, "blocs": blocs}


@query("a8_all_pivots", f"WITH o AS (SELECT o_orderkey AS k, {_LISTED} FROM orders)," + """
    e AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS row_dim, '{b}' AS column_dim, x AS row, unnest({b}) AS column, k FROM (SELECT k, {b}, unnest({a}) AS x FROM o)" for a, b in _PAIRS) + """)
    SELECT row_dim, column_dim, row, "column", count(DISTINCT k) AS records, count(*) AS elements FROM e GROUP BY ALL""", "orders")  # fmt: skip
def _(orders):
    return analytics.all_pivots(orders, _dims())


_CHARTS = {"years": ("year", None), "states": ("status", None), "shares": ("priority", "status"), "tags": ("tags", None), "top": ("band", None)}
_CHOSEN = {"years": "list_contains(year, '1995') OR list_contains(year, '1996')", "states": "status <> ['P']", "top": "band <> ['3']", "tags": "list_contains(tags, 'a')"}


def _chart_sql(name: str) -> str:
    key, part = _CHARTS[name]
    others = " AND ".join(f"coalesce({c}, false)" for n, c in _CHOSEN.items() if n != name)
    return f"SELECT '{name}' AS chart, key, part, count(*) AS n FROM (SELECT k, unnest(list_distinct({key})) AS key, {f'{part}[1]' if part else 'NULL::VARCHAR'} AS part FROM o2 WHERE {others}) GROUP BY ALL"


@query("a9_cross_filter", f"WITH o AS (SELECT o_orderkey AS k, {_LISTED} FROM orders), o2 AS (SELECT * REPLACE (CASE WHEN tags = [NULL::VARCHAR] THEN ['-'] ELSE tags END AS tags) FROM o), c AS (" + " UNION ALL ".join(map(_chart_sql, _CHARTS)) + """),
    t AS (SELECT * REPLACE (nullif(key, '-') AS key), sum(n) OVER (PARTITION BY chart, key) AS of_key, sum(n) OVER (PARTITION BY chart) AS whole FROM c),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY chart ORDER BY of_key DESC, key NULLS LAST)::INT AS rank FROM t)
    SELECT chart, key, part, n, round(n / CASE WHEN chart = 'shares' THEN of_key ELSE whole END, 4) AS share, rank FROM r WHERE chart <> 'top' OR rank <= 3""", "orders")  # fmt: skip
def _(orders):
    d = _dims()
    charts = {"years": (d["year"],), "states": (d["status"],), "shares": (d["priority"], d["status"]), "tags": (d["tags"],), "top": (d["band"],)}
    choices = {"years": d["year"].isin(1995, 1996), "states": d["status"] != "P", "top": d["band"] != 3, "tags": F.array_contains(d["tags"], "a")}
    return analytics.cross_filtered(orders, charts, choices, {"top": 3})


# ---- tables that change together


def committed_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, agreements and state by versions: a first load, a review of some, a dry run and one that lost its base."""
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("number"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 3 == 0, "AC").otherwise("PL").alias("kind"), F.col("o_orderstatus").alias("title"), F.lit("S").alias("origin"))
    known = rows.where("number % 2 = 0")
    first = flows.commit_review(spark, path, known, flows.reviewed_agreements(None, known, known.select("number", "year", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("boolean").alias("announced"), F.lit(None).cast("string").alias("announced_on"))), known.select("number"))
    pages = rows.select("number", "year", F.when(F.col("number") % 5 > 0, F.concat((F.col("number") % 7).cast("string"), F.lit("/26"))).alias("entry"), F.when(F.col("number") % 4 < 2, F.col("number") % 4 == 0).alias("announced"), F.when(F.col("number") % 4 == 0, F.lit("01/02/2026")).alias("announced_on"))
    new = rows.where("number % 2 = 1 AND number % 9 > 0")
    agreements = flows.reviewed_agreements(commits.read(spark, path, "agreements"), rows.where("number % 9 > 0"), pages)
    flows.commit_review(spark, path, known.unionByName(new), agreements, new.select("number"), base=first)
    flows.commit_review(spark, path, known.limit(0), agreements.limit(0), new.select("number"), dry_run=True)
    try:
        flows.commit_review(spark, path, known.limit(0), agreements.limit(0), new.select("number"), base=first)
    except commits.Conflict:
        pass
    told, state = commits.read(spark, path, "agreements"), commits.read(spark, path, "state")
    return commits.read(spark, path, "records").select("number", "year", "kind").join(told, ["number", "year"], "left").join(state.withColumn("done", F.lit(True)), "number", "left").select("number", "year", "kind", "entry", "announced", "announced_on", "approved", "done")


QUERIES["k1_committed_review"] = committed_review
SQL["k1_committed_review"] = """
    WITH r AS (SELECT o_orderkey AS number, year(o_orderdate)::INT AS year, o_orderkey % 3 = 0 AS ac, o_orderkey % 2 = 0 OR o_orderkey % 9 > 0 AS stays, o_orderkey % 9 > 0 AS seen FROM orders)
    SELECT number, year, CASE WHEN ac THEN 'AC' ELSE 'PL' END AS kind, CASE WHEN ac AND seen AND number % 5 > 0 THEN (number % 7)::INT END AS entry,
           CASE WHEN ac THEN coalesce(seen AND number % 4 = 0, false) END AS announced, CASE WHEN ac AND seen AND number % 4 = 0 THEN '01/02/2026' END AS announced_on, CASE WHEN ac THEN false END AS approved, true AS done
    FROM r WHERE stays"""


# ---- rosters in batches and as a stream


def _designations(orders, customer):
    """Decrees on the bodies of nations: one designates two customers, one of them for another."""
    k, cust = F.col("o_orderkey"), as_text("o_custkey")
    name = lambda c: F.concat(F.lit("Ana "), F.translate(c, "0123456789", "ABCDEFGHIJ"), F.lit("X"))
    text = F.concat(F.lit("Artículo 1°- Desígnase a la señora Senadora "), name(cust), F.lit(" y al señor Senador "), name(as_text("o_orderkey")), F.lit(" en la Comisión de B"), (F.col("o_custkey") % 25).cast("string"), F.lit(", en reemplazo de la señora Senadora "), name((F.col("o_custkey") - 25).cast("string")), F.lit("."))
    decrees = orders.where("o_orderkey % 16 = 3").select(k.cast("string").alias("number"), k.cast("int").alias("ord"), text.alias("text"))
    surname = F.concat(F.translate(as_text("c_custkey"), "0123456789", "ABCDEFGHIJ"), F.lit("X"))
    person = customer.select(F.concat(surname, F.lit(", Ana")).alias("name"), F.concat(F.lit("bloc "), "c_mktsegment").alias("bloc"), F.concat(F.lit("B"), (F.col("c_custkey") % 25).cast("string")).alias("body"), "c_custkey")
    member = F.struct("c_custkey", F.struct("name", "bloc", F.when(F.col("c_custkey") % 50 < 25, "Presidente").otherwise("").alias("role")).alias("m"))
    rosters = person.where("c_custkey <= 100").groupBy("body").agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    return decrees, rosters, person.select("name", "bloc")


def _shown_rosters(df):
    return df.select("body", joined(F.transform("members", lambda m: F.concat_ws(":", m["name"], m["bloc"], m["role"]))).alias("members"))


@query("w8_roster_flow", None, "orders", "customer")
def _(orders, customer):
    """Rosters after decrees, with blocs; compared with a Python model in the tests."""
    decrees, rosters, persons = _designations(orders, customer)
    return _shown_rosters(flows.roster_after(rosters, decrees, persons=persons))


def roster_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by micro-batches of a stateful stream, interrupted once; compared with the batch form in the tests."""
    from ledgerloom.streaming.rosters import roster_stream

    decrees, rosters, persons = _designations(spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet"))
    work = f"{shared_dir(spark)}/rosters-{uuid.uuid4().hex}"
    all_changes, out = flows.roster_changes(rosters, decrees, persons=persons), f"{work}/out"
    # Read from the decrees once, not once a part.
    all_changes.write.parquet(f"{work}/all")
    changes = spark.read.schema(all_changes.schema).parquet(f"{work}/all")
    rosters.write.parquet(f"{work}/start")
    start = spark.read.parquet(f"{work}/start")
    # Files of a few batches, dealt by number of decree and not in its order.
    for part in range(2):
        changes.where(F.pmod(F.xxhash64("ord"), F.lit(2)) == part).repartition(2, "ord").write.mode("append").parquet(f"{work}/changes")
        read = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/changes")
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
        roster_stream(read, start).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/log").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("body").agg(F.max_by("members", "batch").alias("__m"))
    return _shown_rosters(start.join(latest, "body", "left").select("body", F.coalesce("__m", "members").alias("members")))


QUERIES["w8_roster_stream"] = roster_by_stream


# ---- text facets by an index


def text_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by pieces of text: an index of a first load, updated by the rows that a merge changed or added."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    key, cust = F.col("o_orderkey"), as_text("o_custkey")
    old = orders.where(key % 3 < 2).select("o_orderkey", F.concat(F.lit("Ley Nº "), cust, F.lit(" DE "), F.lower("o_orderpriority")).alias("title"), F.lit("f").alias("state"))
    new = orders.where(key % 4 > 0).select("o_orderkey", F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Año "), cust, F.lit(", "), F.col("o_orderpriority"))).alias("title"), F.lit("f").alias("state"))
    text_index.update(spark, path, old, "o_orderkey", "title")
    merged = merge.upsert_overwrite(old, new, ["o_orderkey"], ["title", "state"])
    text_index.update(spark, path, merged.where("outcome IN ('inserted', 'updated')"), "o_orderkey", "title")
    one = lambda needle: text_index.search(spark, path, merged, "o_orderkey", "title", needle).select("o_orderkey", F.lit(needle).alias("needle"), "title")
    return reduce(DataFrame.unionByName, map(one, ("AÑO 1", "ley nº 14", "de 1-urgent", ", 5", "12", "4-not specified")))


QUERIES["q1_text_index"] = text_facets
SQL["q1_text_index"] = """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Ley Nº ' || o_custkey || ' DE ' || lower(o_orderpriority) WHEN o_orderkey % 5 > 0 THEN 'Año ' || o_custkey || ', ' || o_orderpriority END AS title FROM orders WHERE o_orderkey % 4 > 0 OR o_orderkey % 3 < 2)
    SELECT o_orderkey, needle, title FROM o JOIN (VALUES ('AÑO 1'), ('ley nº 14'), ('de 1-urgent'), (', 5'), ('12'), ('4-not specified')) t(needle) ON contains(lower(title), lower(needle))"""


# ---- tables from ruling lines


@query("s14_ruled_tables", """
    WITH o AS (SELECT o_orderkey AS doc, o_custkey % 3 AS page, o_orderkey % 2 = 1 AS long, o_orderkey % 3 = 0 AS tall, o_orderstatus || chr(10) || o_orderpriority AS two_lines, o_custkey FROM orders)
    SELECT doc, page, 0 AS tbl, 'senadores' AS section, 0 AS row, o_custkey || '|m1 m2|-' AS cells FROM o
    UNION ALL SELECT doc, page, 0, 'senadores', 1, 'r1|' || two_lines || '|' FROM o
    UNION ALL SELECT doc, page, 0, 'senadores', 2, CASE WHEN tall THEN '-' ELSE '' END || '|z|k' || doc FROM o WHERE long
    UNION ALL SELECT doc, page, 1, 'asesores', 0, 'solo' FROM o""", "orders")
def _(orders):
    """Tables of two and of three rows with a cell over two columns and one over two rows, drawn piece by piece or twice; words of two lines, and outside."""
    k, long, tall = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") % 3 == 0
    end, wide = F.when(long, 80.0).otherwise(60.0), F.lit(200.0) + k % 50
    n = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    seg = lambda x0, top, x1, bottom: F.struct(n(x0).cast("double").alias("x0"), n(top).cast("double").alias("top"), n(x1).cast("double").alias("x1"), n(bottom).cast("double").alias("bottom"))
    drawn = [
        seg(10, 20, 110, 20), seg(110, 20.5, 310, 20.5), seg(310, 40, 10, 40), seg(F.when(tall & long, 110.0).otherwise(10.0), 60, 310, 60), seg(10, end, 310, end),
        seg(10, 20, 10, end), seg(110, 20, 110, end), seg(wide, 40, wide, end), seg(310, 20, 310, end), seg(10, 20, 310, 80),
        seg(50, 200, 90, 200), seg(50, 201, 90, 201), seg(50, 220, 90, 220), seg(50, 200, 50, 220), seg(90, 199, 90, 222), seg(300, 150, 300, 400),
    ]
    word = lambda x, top, text: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(top)).alias("top"), F.lit(x + 8.0).alias("x1"), F.lit(top + 4.0).alias("bottom"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    said = [
        word(20, 25, as_text("o_custkey")), word(250, 25.4, "m2"), word(120, 26, "m1"), word(20, 45, "r1"), word(120, 50, F.col("o_orderpriority")), word(125, 42, F.col("o_orderstatus")),
        word(120, 65, F.when(long, "z")), word(280, 65, F.when(long, F.concat(F.lit("k"), k.cast("string")))), word(60, 207, "solo"), word(400, 30, "out"), word(10, 100, "REUNIONES"), word(30, 101, "de"), word(40, 100, "Asesores"),
    ]
    pages = orders.select(k.alias("doc"), (F.col("o_custkey") % 3).alias("page"), F.array(*drawn).alias("drawn"), F.array(*said).alias("said"))
    words, rulings = pages.select("doc", "page", F.inline("said")).where("text IS NOT NULL"), pages.select("doc", "page", F.inline("drawn"))
    marks = {"asesores": r"REUNIONES\s+DE\s+ASESORES", "bicameral": r"REUNIONES\s+BICAMERAL"}
    found = ordered.section_rows(words, geometry.ruled_tables(words, rulings), marks, "senadores")
    return found.withColumn("cells", F.array_join("cells", "|", "-"))


# ---- approved records, processing order, landed texts


@query("f2_approved_import", """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS known, o_orderkey % 5 > 0 AND (o_orderkey % 7 > 0 OR o_orderkey % 4 < 2) AS told, * FROM orders)
    SELECT k::INT AS number, 2026 AS year, CASE k % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'PL' ELSE '??' END AS kind, CASE WHEN known THEN 'known' WHEN k % 4 < 2 THEN 'early' ELSE 'ley ' || o_orderpriority END AS extract,
    CASE WHEN told AND k % 4 = 0 THEN o_custkey::VARCHAR END AS law, CASE WHEN told AND k % 7 = 0 THEN '07/07/2027' WHEN told AND k % 4 = 1 THEN '01/02/2026' WHEN k % 4 = 2 THEN '03/04/2026' WHEN NOT told THEN 'x' END AS archived_on,
    CASE WHEN told AND k % 4 = 3 THEN '05/06/2026' END AS lapsed_on, CASE WHEN NOT known THEN 'inserted' WHEN NOT told THEN 'kept' WHEN k % 4 = 2 THEN 'unchanged' ELSE 'updated' END AS outcome
    FROM o WHERE known OR told""", "orders")
def _(orders):
    """Rows of unknown kinds and without one, two rows of a record, records that are known, unknown, changed, unchanged and not told."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    kind = F.when(k % 3 == 0, "AC").when(k % 3 == 1, "PL").otherwise("??")
    known = orders.where(k % 2 == 0).select(k.cast("int").alias("number"), F.lit(2026).alias("year"), kind.alias("kind"), F.lit("known").alias("extract"), none.alias("law"), F.when(k % 4 == 2, "03/04/2026").otherwise("x").alias("archived_on"), none.alias("lapsed_on"))
    put = lambda cells, at, value: F.transform(cells, lambda c, i: F.when(i == at, value).otherwise(c))
    early = F.struct((2 * k - 1).alias("ord"), put(put(_workbook_row(), 4, F.lit("early")), 38, F.lit("07/07/2027")).alias("cells"))
    main = F.struct((2 * k).alias("ord"), put(_workbook_row(), 3, F.when(k % 7 == 0, " ").otherwise(kind)).alias("cells"))
    rows = orders.where(k % 5 > 0).select(F.inline(F.when(k % 4 < 2, F.array(early, main)).otherwise(F.array(main))))
    return flows.approved_import(known, rows, "cells", "ord", {"AC": "Agreement", "PL": "Bill"}, ["law", "archived_on", "lapsed_on"])


@query("o3_newest_listed", """
    SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id > 100 AND event_id % 7 > 0) WHERE n = 1""", "events")
def _(events):
    return flows.newest_listed(cols(events, "event_id", "user_id", "event_type"), events.where("event_id % 7 = 0").select("event_id"), "event_id", 100, ["user_id", "event_type"])


@query("s9_below_header", """
    SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderkey <= 10 AND o_orderkey % 3 = 0) AND o_orderkey % 4 > 1""", "orders")
def _(orders):
    """The header stands twice in the first rows and again below; second cells that are null or blank."""
    k = F.col("o_orderkey")
    landed = orders.select("o_orderkey", F.when(k % 3 == 0, "ORIGEN").otherwise("S").alias("c0"), F.when(k % 4 == 0, "  ").when(k % 4 > 1, "x").alias("c1"))
    return cols(landing.below_header(landed, "o_orderkey", "ORIGEN"), "o_orderkey")


@query("s13_page_texts", """
    SELECT l_orderkey, string_agg(l_returnflag || l_partkey, chr(10) ORDER BY l_linenumber, l_returnflag || l_partkey) AS text FROM lineitem WHERE l_partkey % 4 > 1 GROUP BY l_orderkey""", "lineitem")
def _(lineitem):
    """Documents of several pages, some empty or null."""
    text = F.when(F.col("l_partkey") % 4 == 0, "").when(F.col("l_partkey") % 4 > 1, F.concat("l_returnflag", as_text("l_partkey")))
    return landing.page_texts(lineitem.select("l_orderkey", "l_linenumber", text.alias("said")), "l_orderkey", "l_linenumber", "said")
