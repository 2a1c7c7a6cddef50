"""Registered queries of the record operators over the driver's tables, each with its equivalent in SQL.

Every query runs over whole tables. Money is converted once, at the edge, to whole minor units.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import calendar, canonical, decimals, keys, search
from recordloom.operators import folds, listing, policy, relations
from recordloom.plans import archive
from recordloom.sources.tables import read
from recordloom.streaming import inbox, projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return put


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


# --- lists and policies -----------------------------------------------------------------------------------------

NOW = datetime(2001, 9, 1, tzinfo=UTC)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as list items, with an org path, a currency and the owner."""
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = read(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read(spark, sf, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), cents("o_totalprice").alias("cents"),
        F.when(F.col("n_regionkey") == 3, "EUR").otherwise("USD").alias("currency"), F.concat_ws("/", "r_name", "n_name").alias("path"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


ITEMS = """items AS (
  SELECT o_orderkey AS order_id, c_name AS name, c_mktsegment AS segment, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CASE WHEN n_regionkey = 3 THEN 'EUR' ELSE 'USD' END AS currency, r_name || '/' || n_name AS path, CAST(o_orderdate AS DATE) AS day,
    o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

RESOURCE = policy.Resource(
    dimensions={"dept": policy.Dimension("path"), "amount": policy.Dimension("cents", "currency"), "segment": policy.Dimension("segment"), "owner": policy.Dimension("name")},
    fields={"order_id": policy.ORDINARY, "name": policy.ORDINARY, "segment": policy.ORDINARY, "day": policy.ORDINARY, "cents": policy.RESTRICTED, "path": policy.RESTRICTED, "status": policy.SECRET},
)
ALL = policy.Atom("all")


def segment(operation: str, reads: tuple[str, ...], since: str = "2000-01-01T00:00:00+00:00", until: str | None = None, **atoms: policy.Atom) -> policy.Segment:
    return policy.Segment(operation, {name: atoms.get(name, ALL) for name in RESOURCE.dimensions}, reads, since, until)


OPEN_FIELDS = ("order_id", "name", "segment", "day")
SEGMENTS = [
    segment("view", (*OPEN_FIELDS, "cents", "path", "status"), dept=policy.Atom("tree", items=(("EUROPE", True), ("ASIA/NATION_2", False))), amount=policy.Atom("interval", currency="EUR", low="5000000", high="30000000", high_closed=False)),
    segment("view", OPEN_FIELDS, segment=policy.Atom("in", values=("BUILDING", "MACHINERY"))),
    segment("view", (*OPEN_FIELDS, "path"), owner=policy.Atom("self")),
    segment("view", (*OPEN_FIELDS, "cents"), since="2002-01-01T00:00:00+00:00"),  # not yet active
    segment("view", (*OPEN_FIELDS, "cents"), until="2001-01-01T00:00:00+00:00"),  # expired
    segment("view", OPEN_FIELDS, segment=policy.Atom("in")),
    segment("export", (*OPEN_FIELDS, "cents"), segment=policy.Atom("in", values=("BUILDING", "FURNITURE")), amount=policy.Atom("interval", currency="USD", low="10000000", low_closed=False)),
]
PRINCIPAL = "Customer#000000007"
S1 = "((path = 'EUROPE' OR path LIKE 'EUROPE/%' OR path = 'ASIA/NATION_2') AND cents IS NOT NULL AND currency = 'EUR' AND cents >= 5000000 AND cents < 30000000)"
S2 = "segment IN ('BUILDING', 'MACHINERY')"
S3 = f"name = '{PRINCIPAL}'"
VISIBLE = f"({S1} OR {S2} OR {S3} OR FALSE)"
EXPORT = "(segment IN ('BUILDING', 'FURNITURE') AND cents IS NOT NULL AND currency = 'USD' AND cents > 10000000)"


def view_plan(operation: str = "view") -> policy.Plan:
    return policy.compile_plan(RESOURCE, SEGMENTS, operation, PRINCIPAL, NOW)


def listed() -> listing.Spec:
    column = listing.Listed
    return listing.Spec(
        {"order_id": column("order_id", "long"), "name": column("name", "string"), "day": column("day", "date"), "segment": column("segment", "string"), "cents": column("cents", "long")},
        "order_id", "long", {"search_name": ("name",)},
    )


HITS = f"concat_ws(',', CAST({S1} AS INT), CAST({S2} AS INT), CAST({S3} AS INT), 0)"


def page_columns(df: DataFrame) -> DataFrame:
    return df.select("order_id", "name", "day", "segment", "cents", F.array_join(F.transform("hits", lambda h: h.cast("int").cast("string")), ",").alias("hits"))


@registered(f"WITH {ITEMS} SELECT order_id, name, day, segment, cents, {HITS} AS hits FROM items WHERE {VISIBLE} ORDER BY day DESC, name, order_id LIMIT 50")
def list_page_first(spark: SparkSession, sf: str) -> DataFrame:
    page = listing.build(listed(), view_plan(), listing.Request(sort=(("day", True), ("name", False))))
    return page_columns(page.shown(items(spark, sf)))


@registered(f"WITH {ITEMS} SELECT order_id, name, day, segment, cents, {HITS} AS hits FROM items WHERE {VISIBLE} ORDER BY day DESC, name, order_id LIMIT 50 OFFSET 50")
def list_page_resume(spark: SparkSession, sf: str) -> DataFrame:
    request = listing.Request(sort=(("day", True), ("name", False)))
    first = listing.build(listed(), view_plan(), request)
    rows = first.rows(items(spark, sf)).collect()  # one page
    if len(rows) <= first.limit:
        return page_columns(first.rows(items(spark, sf)).limit(0))
    cursor = first.next_cursor(rows[first.limit - 1].asDict())
    return page_columns(listing.build(listed(), view_plan(), listing.Request(sort=request.sort, cursor=cursor)).shown(items(spark, sf)))


@registered(
    f"WITH {ITEMS} SELECT order_id, name, day, segment, cents, {HITS} AS hits FROM items WHERE {VISIBLE} AND {S1} "
    "AND segment IN ('BUILDING', 'HOUSEHOLD') AND day >= DATE '1997-01-01' AND cents < 25000000 ORDER BY cents DESC, order_id LIMIT 200"
)
def list_filters(spark: SparkSession, sf: str) -> DataFrame:
    filters = (listing.Filter("segment", "in", ("BUILDING", "HOUSEHOLD")), listing.Filter("day", "gte", ("1997-01-01",)), listing.Filter("cents", "lt", ("25000000",)))
    page = listing.build(listed(), view_plan(), listing.Request(filters=filters, sort=(("cents", True),), limit=200, readable_only=("cents",)))
    return page_columns(page.shown(items(spark, sf)))


@registered("SELECT doc_id, strpos(lower(text), 'idiot') > 0 AS hit, length(replace(replace(replace(lower(text), chr(10), ''), chr(9), ''), chr(13), '')) AS folded_chars FROM documents WHERE text IS NOT NULL")
def list_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", search.fold("text").alias("folded"))
    return rows.select("doc_id", search.matches(F.col("folded"), " IDIOT ").alias("hit"), F.char_length("folded").cast("long").alias("folded_chars"))


@registered(f"WITH {ITEMS} SELECT order_id, {HITS} AS hits FROM items WHERE {VISIBLE}")
def policy_hits(spark: SparkSession, sf: str) -> DataFrame:
    plan = view_plan()
    rows = items(spark, sf).where(plan.where).withColumn("hits", plan.hit_array())
    return rows.select("order_id", F.array_join(F.transform("hits", lambda h: h.cast("int").cast("string")), ",").alias("hits"))


@registered(f"WITH {ITEMS} SELECT segment, currency, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents FROM items WHERE {VISIBLE} AND {EXPORT} GROUP BY segment, currency")
def policy_visible(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf).where(view_plan("export").where)
    return rows.groupBy("segment", "currency").agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"))


@registered(
    f"""WITH {ITEMS}, v AS (SELECT *, coalesce({S1}, FALSE) AS a, {S2} AS b, {S3} AS c FROM items WHERE {VISIBLE})
SELECT CASE WHEN a THEN cents END AS cents, day, name, order_id, CASE WHEN a OR c THEN path END AS path, segment,
  CASE WHEN a THEN NULL WHEN c THEN 'cents' ELSE 'cents,path' END AS masked FROM v"""
)
def policy_mask(spark: SparkSession, sf: str) -> DataFrame:
    plan = view_plan()
    rows = policy.masked(items(spark, sf).where(plan.where), RESOURCE, plan.readable())
    return rows.withColumn("masked", F.array_join(policy.MASKED, ",")).drop(policy.MASKED)


@registered(
    """WITH f AS (
  SELECT c_custkey, c_mktsegment AS seg, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_custkey % 4 AS s, c_custkey % 3 AS t FROM customer),
a AS (SELECT *, CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN FALSE ELSE seg IN ('BUILDING', 'MACHINERY') END AS x,
  CASE WHEN t = 0 THEN NULL WHEN t = 1 THEN FALSE ELSE cents >= 100000 END AS y,
  CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN FALSE ELSE seg = 'FURNITURE' END AS z FROM f),
v AS (SELECT *, (x AND y) OR z AS visible FROM a)
SELECT c_custkey, CASE WHEN visible THEN 'true' WHEN NOT visible THEN 'false' ELSE 'unknown' END AS visible,
  CASE WHEN visible THEN concat_ws(',', CASE WHEN x AND y THEN 'cents' END, 'day') ELSE '' END AS fields,
  CASE WHEN NOT visible THEN 'NOT_FOUND' WHEN visible IS NULL THEN 'AUTHORIZATION_UNPROVABLE' END AS error FROM v"""
)
def policy_three_valued(spark: SparkSession, sf: str) -> DataFrame:
    def fact(value: Column, by: Column, currency: str | None = None) -> Column:
        state = F.when(by == 0, "unobtained").when(by == 1, "null").otherwise("value")
        return F.struct(state.alias("state"), F.when(by > 1, value.cast("string")).alias("value"), F.lit(currency).cast("string").alias("currency"))

    resource = policy.Resource({"segment": policy.Dimension("segment"), "amount": policy.Dimension("cents", "currency")}, {"cents": policy.RESTRICTED, "day": policy.ORDINARY})
    since = "2000-01-01T00:00:00+00:00"
    segments = [
        policy.Segment("view", {"segment": policy.Atom("in", values=("BUILDING", "MACHINERY")), "amount": policy.Atom("interval", currency="USD", low="100000")}, ("cents", "day"), since),
        policy.Segment("view", {"segment": policy.Atom("in", values=("FURNITURE",)), "amount": ALL}, ("day",), since),
    ]
    rows = read(spark, sf, "customer")
    facts = {"segment": fact(F.col("c_mktsegment"), F.col("c_custkey") % 4), "amount": fact(cents("c_acctbal"), F.col("c_custkey") % 3, "USD")}
    told = policy.evaluate(resource, segments, "view", facts, PRINCIPAL, NOW)
    name = F.when(told["visible"], "true").when(~told["visible"], "false").otherwise("unknown")
    return rows.select("c_custkey", name.alias("visible"), F.array_join(told["fields"], ",").alias("fields"), policy.decision_error(told["visible"], told["action"]).alias("error"))


# --- joins ------------------------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return relations.orphans(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", read(spark, sf, "lineitem"), "l_orderkey").select("o_orderkey", "o_orderstatus")


@registered(
    """SELECT r_name AS root_id, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def join_parent_chain(spark: SparkSession, sf: str) -> DataFrame:
    tables = {name: read(spark, sf, name) for name in ("region", "nation", "customer", "orders")}
    children = [
        relations.Child("orders", "customer", "o_custkey", "c_custkey"), relations.Child("customer", "nation", "c_nationkey", "n_nationkey"), relations.Child("nation", "region", "n_regionkey", "r_regionkey"),
    ]
    tables["region"] = tables["region"].withColumn("key", F.col("r_name"))
    rooted = relations.with_roots(tables, "region", "key", children)["orders"]
    return rooted.groupBy("root_id").agg(F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("cents"))


@registered(
    """SELECT o_orderkey AS root_id, count(l_orderkey) AS lines, sha256(coalesce(string_agg(l_partkey || ':' || l_linenumber || ':' || CAST(l_quantity AS INT), ',' ORDER BY l_linenumber, l_partkey, l_quantity), '')) AS digest
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def join_assemble(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("a_line"), F.col("l_partkey").alias("b_part"), F.col("l_quantity").cast("int").alias("c_quantity"))
    whole = relations.assembled({"orders": read(spark, sf, "orders").select("o_orderkey"), "lines": lines}, "orders", "o_orderkey", [relations.Child("lines", "orders", "l_orderkey", "o_orderkey")])
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["b_part"].cast("string"), x["a_line"].cast("string"), x["c_quantity"].cast("string"))), ",")
    return whole.select("root_id", F.size("lines").cast("long").alias("lines"), F.sha2(text, 256).alias("digest"))


UNITS_SQL = """members AS (SELECT o_orderpriority || '~' || strftime(o_orderdate, '%Y-%m') AS unit, o_orderkey AS root_id, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '2000-08-31'),
units AS (SELECT unit, 'orders' AS class, count(*) AS members, max(o_orderdate) AS anchor_max, CASE WHEN min(o_orderdate) < TIMESTAMP '1997-01-01' THEN 'released' WHEN min(o_orderdate) < TIMESTAMP '1999-01-01' THEN 'published' ELSE 'sealed' END AS state FROM members GROUP BY unit)"""


def sealed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Units and members of the orders that are due for the archive, in states by age."""
    found = archive.candidates(read(spark, sf, "orders"), spark.createDataFrame([], "root_id long"), ORDERS, F.lit("2001-08-31").cast("timestamp_ntz"))
    members = found.select(F.concat_ws("~", "o_orderpriority", "period").alias("unit"), F.col("o_orderkey").alias("root_id"), "o_orderdate")
    state = F.when(F.min("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "released").when(F.min("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "published").otherwise("sealed")
    units = members.groupBy("unit").agg(F.count("*").alias("members"), F.max("o_orderdate").alias("anchor_max"), state.alias("state")).withColumn("class", F.lit("orders"))
    return units, members.select("unit", "root_id")


ORDERS = archive.ArchiveClass("orders", "o_orderkey", ("o_orderpriority",), "o_orderdate", "o_orderstatus = 'F'", 365)


@registered(
    f"""WITH {UNITS_SQL}, scopes AS (
  SELECT 'r' || o_orderkey AS hold_id, 'record' AS scope_kind, 'orders/' || o_orderkey AS scope FROM orders WHERE o_custkey % 97 = 0
  UNION ALL SELECT 'u' || unit, 'unit', unit FROM units WHERE unit LIKE '1-URGENT~1998%' UNION ALL SELECT 'c1', 'class', 'orders' UNION ALL SELECT 'c2', 'class', 'invoices'),
hits AS (SELECT unit, hold_id FROM units JOIN scopes ON scope_kind = 'unit' AND scope = unit
  UNION SELECT unit, hold_id FROM units JOIN scopes ON scope_kind = 'class' AND scope = class
  UNION SELECT m.unit, hold_id FROM members m JOIN scopes ON scope_kind = 'record' AND scope = 'orders/' || root_id)
SELECT unit, count(hold_id) AS holds FROM units LEFT JOIN hits USING (unit) GROUP BY unit"""
)
def join_disjunctive_holds(spark: SparkSession, sf: str) -> DataFrame:
    units, members = sealed(spark, sf)
    none = F.lit(None).cast("date").alias("released_at")
    records = read(spark, sf, "orders").where("o_custkey % 97 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("hold_id"), F.lit("record").alias("scope_kind"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("scope"), none)
    own = units.where("unit LIKE '1-URGENT~1998%'").select(F.concat(F.lit("u"), "unit").alias("hold_id"), F.lit("unit").alias("scope_kind"), F.col("unit").alias("scope"), none)
    classes = spark.createDataFrame([("c1", "class", "orders"), ("c2", "class", "invoices")], "hold_id string, scope_kind string, scope string").select("*", none)
    return relations.covering(units, records.unionByName(own).unionByName(classes), members)


@registered(
    """WITH a AS (SELECT s_suppkey % 40 AS employee_id, s_nationkey AS legal_entity, 'p' || (s_suppkey % 7) AS position_id, CASE s_suppkey % 5 WHEN 0 THEN 'ended' WHEN 1 THEN 'planned' ELSE 'active' END AS state,
  DATE '2020-01-01' + CAST(s_suppkey % 300 AS INT) AS start_date, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2020-06-01' + CAST(s_suppkey % 200 AS INT) END AS end_date FROM supplier),
l AS (SELECT c_custkey % 40 AS employee_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS account, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'closed' END AS state FROM customer)
SELECT DISTINCT legal_entity, position_id, account FROM a JOIN l USING (employee_id) WHERE a.state IN ('planned', 'active') AND start_date <= DATE '2020-08-15' AND (end_date IS NULL OR end_date >= DATE '2020-08-15')
AND l.state = 'active' AND account IS NOT NULL"""
)
def join_interval_holders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    appointments = read(spark, sf, "supplier").select(
        (k % 40).alias("employee_id"), F.col("s_nationkey").alias("legal_entity"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("position_id"),
        F.when(k % 5 == 0, "ended").when(k % 5 == 1, "planned").otherwise("active").alias("state"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")).alias("start_date"),
        F.when(k % 3 != 0, F.date_add(F.lit("2020-06-01").cast("date"), (k % 200).cast("int"))).alias("end_date"),
    )
    c = F.col("c_custkey")
    links = read(spark, sf, "customer").select((c % 40).alias("employee_id"), F.when(c % 11 != 0, F.col("c_name")).alias("account"), F.when(c % 2 == 0, "active").otherwise("closed").alias("state"))
    return relations.holders(appointments, links, F.lit("2020-08-15").cast("date"), ["legal_entity", "position_id"])


@registered(
    """WITH asked AS (SELECT o_orderkey AS id, o_orderkey % 5 AS version FROM orders UNION ALL SELECT -o_orderkey - 1, 1 FROM orders WHERE o_orderkey % 100 = 0),
current AS (SELECT l_orderkey AS id, count(*) AS found FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN found IS NULL THEN 'absent' WHEN found < version THEN 'older' ELSE 'present' END AS answer, found AS version FROM asked LEFT JOIN current USING (id)"""
)
def join_presence(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    asked = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("version")).unionByName(orders.where("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("id"), F.lit(1).cast("long").alias("version")))
    current = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("version"))
    return relations.presence(asked, current)


@registered(
    """WITH asked AS (SELECT o_orderkey AS place, o_custkey * 3 AS id FROM orders), live AS (SELECT c_custkey AS id, c_nationkey + 1 AS v FROM customer WHERE c_custkey % 2 = 0), gone AS (SELECT c_custkey AS id, 100 + c_nationkey AS g FROM customer WHERE c_custkey % 2 = 1)
SELECT place, id, CASE WHEN v IS NOT NULL THEN 'exists' WHEN g IS NOT NULL THEN 'tombstone' ELSE 'purged' END AS state, CAST(coalesce(v, g, 0) AS BIGINT) AS version FROM asked LEFT JOIN live USING (id) LEFT JOIN gone USING (id)"""
)
def join_batch_read(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") * 3).alias("id"))
    customer = read(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    live = customer.where("id % 2 = 0").select("id", (F.col("c_nationkey") + 1).cast("long").alias("version"))
    gone = customer.where("id % 2 = 1").select("id", (F.col("c_nationkey") + 100).cast("long").alias("version"))
    return relations.batch_read(asked, live, gone)


@registered(
    """WITH open AS (SELECT o_orderkey AS r, CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'sending' ELSE 'unknown' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS fr, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 2 HOUR END AS lr,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS ex, CASE WHEN o_orderstatus = 'F' THEN 400000000 ELSE 0 END AS dd, o_orderkey % 2 = 0 AS lu, CASE WHEN o_orderkey % 7 = 0 THEN 86400 ELSE 0 END AS pr FROM orders WHERE o_orderstatus <> 'P'),
ext AS (SELECT o_orderkey AS r, CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'processing' END AS es FROM orders WHERE o_orderkey % 11 = 0),
loc AS (SELECT o_orderkey AS r FROM orders WHERE o_orderkey % 2 = 0), iss AS (SELECT o_orderkey AS r FROM orders WHERE o_orderkey % 13 = 0),
k AS (SELECT open.*, es, coalesce(fr, TIMESTAMP '2001-01-01') AS f1 FROM open LEFT JOIN ext USING (r)),
d AS (SELECT *, CASE WHEN dd > 0 THEN (CASE WHEN lu AND lr IS NOT NULL THEN lr ELSE f1 END) + to_seconds(CAST(dd - greatest(dd / 10, 3600) AS BIGINT)) END AS dl, greatest(lr, TIMESTAMP '2001-06-01') AS la FROM k),
ours AS (SELECT r, CASE WHEN es IS NOT NULL THEN 'matched' WHEN state = 'manual' THEN 'manual' WHEN dl >= TIMESTAMP '2001-09-01' THEN 'deadline' WHEN ex < TIMESTAMP '2001-09-01' OR (pr > 0 AND la + to_seconds(pr) < TIMESTAMP '2001-09-01') THEN 'unknown' ELSE 'manual' END AS conclusion,
  CASE WHEN es IN ('succeeded', 'failed', 'rejected') THEN es WHEN es IS NOT NULL THEN 'accepted' END AS state FROM d),
known AS (SELECT r FROM loc UNION SELECT r FROM open)
SELECT r AS reference, conclusion, state FROM ours UNION ALL SELECT r, 'external_only', NULL FROM ext WHERE r NOT IN (SELECT r FROM known)
UNION ALL SELECT r, 'possibly_executed', NULL FROM iss WHERE r NOT IN (SELECT r FROM known) AND r NOT IN (SELECT r FROM ext)"""
)
def join_full_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    k, orders = F.col("o_orderkey"), read(spark, sf, "orders")
    at = F.col("o_orderdate")
    open_ = orders.where("o_orderstatus <> 'P'").select(
        k.alias("reference"), F.when(k % 4 == 0, "manual").when(k % 4 == 1, "sending").otherwise("unknown").alias("state"),
        F.when(k % 3 == 0, at).alias("first_reached"), F.when(k % 6 == 0, at + F.expr("INTERVAL 2 HOURS")).alias("last_reached"), F.lit(None).cast("timestamp_ntz").alias("sending_at"),
        F.when(k % 5 == 0, at + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", 400_000_000).otherwise(0).alias("dedupe_s"), (k % 2 == 0).alias("last_use"),
        F.when(k % 7 == 0, 86_400).otherwise(0).alias("processing_s"),
    )
    external = orders.where("o_orderkey % 11 = 0").select(k.alias("reference"), F.when(k % 3 == 0, "succeeded").when(k % 3 == 1, "failed").otherwise("processing").alias("state"))
    local, issued = orders.where("o_orderkey % 2 = 0").select(k.alias("reference")), orders.where("o_orderkey % 13 = 0").select(k.alias("reference"))
    point, until, now = (F.lit(t).cast("timestamp_ntz") for t in ("2001-01-01", "2001-06-01", "2001-09-01"))
    return relations.reconciled(open_, external, local, issued, point, until, now)


# --- events: streams, numbering, progress -----------------------------------------------------------------------

FNV = "CAST(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) % {1} AS INT)"


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an outbox of one stream in two epochs: 8 partitions by the user, a new epoch from mid-January on."""
    e = read(spark, sf, "events")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("record_id"), "event_type", "ts", keys.partition_of(F.concat(F.lit("user-"), F.col("user_id").cast("string")), 8).alias("partition"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(1)).otherwise(2).cast("long").alias("generation"), "props", "value",
    )


OUTBOX = f"outbox AS (SELECT event_id, CAST(user_id AS VARCHAR) AS record_id, event_type, ts, {FNV.format(chr(40) + chr(39) + 'user-' + chr(39) + ' || user_id' + chr(41), 8)} AS partition, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1::BIGINT ELSE 2 END AS generation, props, value FROM events)"


@registered(f"WITH {OUTBOX} SELECT event_id, partition, generation, row_number() OVER (PARTITION BY partition, generation ORDER BY event_id) AS seq FROM outbox")
def win_epoch_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return folds.numbered(outbox(spark, sf), ["partition", "generation"], ["event_id"], ranges=64).select("event_id", "partition", "generation", "seq")


@registered("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def win_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return folds.numbered_in_ranges(read(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 1000, 16).select("event_id", "seq")


@registered("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return folds.latest(read(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@registered(
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type FROM events),
k AS (SELECT user_id, event_id, seq FROM e WHERE NOT (event_type = 'error' AND seq % 3 = 0) AND seq > 2),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM k) SELECT user_id, event_id, seq FROM p WHERE seq - n = 2"""
)
def win_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.numbered(read(spark, sf, "events"), ["user_id"], ["event_id"]).where("NOT (event_type = 'error' AND seq % 3 = 0)").withColumn("applied", F.lit(2).cast("long"))
    return folds.contiguous(rows, ["user_id"], "applied").select("user_id", "event_id", "seq")


CUT = """runs AS (SELECT user_id % 10 AS subscription, ts AS s, lead(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS e FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup')),
handled AS (SELECT user_id % 10 AS subscription, event_id % 4 AS partition, ts AS a, event_id FROM events WHERE event_type <> 'signup'),
last AS (SELECT r.subscription, s, max(a) - INTERVAL 10 MINUTE AS cut FROM runs r JOIN handled h ON r.subscription = h.subscription AND a >= s AND (e IS NULL OR a < e) GROUP BY ALL),
cuts AS (SELECT subscription, arg_max(cut, s) AS cut FROM last WHERE s <= cut GROUP BY subscription)"""


def subscription_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "events").withColumn("subscription", F.col("user_id") % 10)
    runs = e.where("event_type = 'signup'").select("subscription", F.col("ts").alias("started_at"))
    handled = e.where("event_type <> 'signup'").select("subscription", F.col("ts").alias("at"), (F.col("event_id") % 4).alias("partition"), F.struct(F.lit(1).cast("long").alias("generation"), F.lit(0).cast("long").alias("timeline"), F.col("event_id").alias("seq")).alias("position"))
    return runs, handled


@registered(f"WITH {CUT} SELECT subscription, cut FROM cuts")
def win_cut(spark: SparkSession, sf: str) -> DataFrame:
    return folds.cut(*subscription_log(spark, sf), F.expr("INTERVAL 10 MINUTES"), ["subscription"])


@registered(f"WITH {CUT} SELECT subscription, partition, max(event_id) AS seq FROM handled JOIN cuts USING (subscription) WHERE a <= cut GROUP BY ALL")
def agg_progress_max_position(spark: SparkSession, sf: str) -> DataFrame:
    runs, handled = subscription_log(spark, sf)
    cuts = folds.cut(runs, handled, F.expr("INTERVAL 10 MINUTES"), ["subscription"])
    return folds.progress(handled, cuts, ["subscription"], ["partition"]).select("subscription", "partition", "position.seq")


@registered(
    f"""WITH {CUT}, p AS (SELECT 'sub' || subscription AS sub, partition, max(event_id) AS seq FROM handled JOIN cuts USING (subscription) WHERE a <= cut AND NOT (subscription = 3 AND partition = 1) GROUP BY ALL)
SELECT partition, min(seq) AS seq FROM p GROUP BY partition HAVING count(DISTINCT sub) = (SELECT count(DISTINCT subscription) FROM handled)"""
)
def stream_redelivery_starts(spark: SparkSession, sf: str) -> DataFrame:
    runs, handled = subscription_log(spark, sf)
    cuts = folds.cut(runs, handled, F.expr("INTERVAL 10 MINUTES"), ["subscription"])
    here = [F.lit("shop").alias("component"), F.lit("users").alias("stream")]
    done = folds.progress(handled, cuts, ["subscription"], ["partition"]).where("NOT (subscription = 3 AND partition = 1)").select("*", *here, F.lit("impl-1").alias("impl"))
    return folds.redelivery_starts(handled.select("subscription", *here), done).select("partition", "position.seq")


@registered(
    f"""WITH {OUTBOX}, c AS (SELECT partition, count(*) FILTER (WHERE generation = 2) AS last_seq, count(*) FILTER (WHERE generation = 1) AS fork, max(partition) AS q FROM outbox GROUP BY partition),
asked AS (SELECT CAST(p AS INT) AS partition, CAST(g AS INT) AS g, CASE WHEN s >= 0 THEN CAST(s AS BIGINT) END AS s FROM range(10) t(p), (VALUES (1), (2), (3)) v(g), (VALUES (-1), (0), (40), (300), (100000)) w(s))
SELECT partition, g AS generation, s AS after_seq, c.last_seq IS NOT NULL AND (s IS NULL OR g < 1 OR (g = 1 AND s < 50)) AS beyond,
 CASE WHEN s IS NULL THEN FALSE WHEN c.last_seq IS NULL THEN TRUE WHEN g = 2 THEN s > c.last_seq WHEN g = 1 THEN s > fork ELSE TRUE END AS ahead FROM asked LEFT JOIN c USING (partition)"""
)
def resend_coverage(spark: SparkSession, sf: str) -> DataFrame:
    def epoch(generation: Column) -> Column:
        return F.struct(generation.cast("long").alias("generation"), F.lit(0).cast("long").alias("timeline"))

    stream = F.lit("users").alias("stream")
    counts = outbox(spark, sf).groupBy("partition").agg(F.count_if(F.col("generation") == 2).alias("last_seq"), F.count_if(F.col("generation") == 1).alias("fork_seq"))
    purged = F.struct(F.lit(1).cast("long").alias("generation"), F.lit(0).cast("long").alias("timeline"), F.lit(50).cast("long").alias("seq"))
    counters = counts.select(stream, "partition", epoch(F.lit(2)).alias("epoch"), "last_seq", purged.alias("purged"))
    forks = counts.select(stream, "partition", epoch(F.lit(1)).alias("old_epoch"), "fork_seq")
    grid = spark.range(10).select(F.col("id").cast("int").alias("partition"), F.explode(F.array(*[F.lit(g) for g in (1, 2, 3)])).alias("generation")).withColumn("s", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 40, 300, 100_000)])))
    asked = grid.select(stream, "partition", "generation", epoch(F.col("generation")).alias("epoch"), F.when(F.col("s") >= 0, F.col("s").cast("long")).alias("after_seq"))
    return folds.resend_coverage(asked, counters, forks).select("partition", "generation", "after_seq", "beyond", "ahead")


@registered(
    """WITH s AS (SELECT user_id % 12 AS stream, CAST(user_id % 5 AS INT) AS partition, count(*) AS n FROM events WHERE user_id % 7 <> 0 GROUP BY ALL),
every AS (SELECT CAST(st AS BIGINT) AS stream, CAST(p AS INT) AS partition FROM range(12) a(st), range(8) b(p)) SELECT stream, partition, coalesce(n, 0) AS high FROM every LEFT JOIN s USING (stream, partition)"""
)
def join_high_water(spark: SparkSession, sf: str) -> DataFrame:
    here = [F.lit(2).alias("generation"), F.lit(0).alias("timeline")]
    counters = read(spark, sf, "events").where("user_id % 7 <> 0").groupBy((F.col("user_id") % 12).alias("stream"), (F.col("user_id") % 5).cast("int").alias("partition")).agg(F.count("*").alias("last_seq")).select("*", *here)
    streams = spark.range(12).select(F.col("id").alias("stream"), F.lit(8).alias("partitions"), *here)
    return relations.high_water(streams, counters)


@registered(f"SELECT DISTINCT user_id, {FNV.format('lower(' + chr(39) + 'User-' + chr(39) + ' || user_id)', 64)} AS partition FROM events")
def hash_partition(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id").distinct().select("user_id", keys.partition_of(F.concat(F.lit("User-"), F.col("user_id").cast("string")), 64).alias("partition"))


@registered("WITH o AS (SELECT event_id, 'e-' || event_id AS id, props FROM events) SELECT event_id, sha256(CAST(id AS BLOB) || '\\x00'::BLOB || CAST(props AS BLOB)) AS digest FROM o")
def digest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", canonical.row_digest(F.concat(F.lit("e-"), F.col("event_id").cast("string")), F.col("props")).alias("digest"))


@registered(
    """WITH d AS (SELECT user_id % 3 AS principal, date_trunc('day', ts) + to_minutes(event_id % 2) AS h FROM events WHERE event_type IN ('error', 'view'))
SELECT principal, h AS minute, count(*) - 2 AS overflow, min(h) AS first_at, max(h) AS last_at FROM d GROUP BY 1, 2 HAVING count(*) > 2"""
)
def agg_minute_budget(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 2).cast("int"))
    denials = read(spark, sf, "events").where("event_type IN ('error', 'view')").select((F.col("user_id") % 3).alias("principal"), at.alias("at"))
    return folds.overflow(denials, ["principal"], "at", 2).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@registered("SELECT user_id % 3 AS principal, event_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('hour', ts) ORDER BY ts, event_id) <= 5 AS detail FROM events")
def win_first_of_minute(spark: SparkSession, sf: str) -> DataFrame:
    denials = read(spark, sf, "events").select((F.col("user_id") % 3).alias("principal"), "event_id", "ts", F.date_trunc("hour", "ts").alias("at"))
    return folds.minute_budget(denials, ["principal"], "at", ["ts", "event_id"], 5).select("principal", "event_id", "detail")


@registered(
    "SELECT user_id % 20 AS source, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND user_id > 140) = 0 THEN CAST(min(CASE WHEN NOT (event_type = 'error' AND user_id > 140) THEN event_id END) AS BIGINT) END AS watermark FROM events GROUP BY 1"
)
def agg_null_poison_min(spark: SparkSession, sf: str) -> DataFrame:
    marks = read(spark, sf, "events").select((F.col("user_id") % 20).alias("source"), F.when(~((F.col("event_type") == "error") & (F.col("user_id") > 140)), F.col("event_id")).alias("mark"))
    return folds.watermark(marks, ["source"], "mark")


@registered(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE value > 50) AS large, min(CASE WHEN event_type = 'error' THEN ts END) AS first_failed, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id"""
)
def agg_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("large"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("first_failed"), F.count_distinct("event_type").alias("kinds")
    )


@registered("SELECT user_id % 8 AS partition, max(CASE WHEN event_type = 'view' AND event_id <= 5000 THEN value END) AS mark FROM events GROUP BY 1")
def agg_last_echo(spark: SparkSession, sf: str) -> DataFrame:
    echoes = read(spark, sf, "events").select((F.col("user_id") % 8).alias("partition"), (F.col("event_type") == "view").alias("recorded"), F.col("event_id").alias("seq"), F.col("value").alias("pulled_at"), F.lit(5000).alias("reach"))
    return folds.last_echo(echoes, ["partition"], "reach")


# --- sets -------------------------------------------------------------------------------------------------------


@registered("SELECT user_id, event_type FROM events WHERE value IS NULL OR value < 5 UNION SELECT user_id, event_type FROM events WHERE event_type = 'error'")
def set_union_pending(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.where("value IS NULL OR value < 5").select("user_id", "event_type").union(e.where("event_type = 'error'").select("user_id", "event_type")).distinct()


@registered(
    """WITH d AS (SELECT 'k' || (event_id % 6000) AS event_id, event_id AS seq, ts FROM events), h AS (SELECT 'k' || (event_id % 6000) AS event_id FROM events WHERE event_type = 'signup')
SELECT event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, seq) AS n FROM d) WHERE n = 1 AND event_id NOT IN (SELECT event_id FROM h)"""
)
def set_dedup_inbox(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    key = F.concat(F.lit("k"), (F.col("event_id") % 6000).cast("string"))
    seen = e.where("event_type = 'signup'").select(F.lit("sub").alias("subscription"), key.alias("event_id"))
    return inbox.once(e.select(key.alias("event_id"), F.col("event_id").alias("seq"), F.col("ts").alias("delivered_at")), seen, "sub").select("event_id", "seq")


@registered(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT CAST(1 AS INT) AS node UNION SELECT CAST(b AS INT) FROM r JOIN e ON a = node) SELECT node FROM r"""
)
def set_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges = read(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("target"))
    return folds.closure(spark.createDataFrame([(1,)], "node int"), edges)


@registered(
    """WITH old AS (SELECT c_custkey AS k, c_nationkey AS v, 'old' AS side FROM customer), new AS (SELECT o_custkey AS k, max(o_orderkey % 25) AS v, 'new' AS side FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN n.v IS NULL OR o.v > n.v THEN o.v ELSE n.v END AS v, CASE WHEN n.v IS NULL OR o.v > n.v THEN 'old' ELSE 'new' END AS side FROM old o LEFT JOIN new n USING (k)"""
)
def set_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"), F.lit("old").alias("side"))
    new = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.col("o_orderkey") % 25).alias("v")).withColumn("side", F.lit("new"))
    return folds.merged(old, new, ["k"], ["v"])


# --- money, dates -----------------------------------------------------------------------------------------------


@registered(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS w, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS i FROM lineitem),
t AS (SELECT l.*, CAST(round(o_totalprice * 100) AS BIGINT) AS total, sum(w) OVER (PARTITION BY l_orderkey) AS s FROM l JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST(total::HUGEINT * w // s AS BIGINT) AS base, total::HUGEINT * w % s AS rest FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, i) AS n, total - sum(base) OVER (PARTITION BY l_orderkey) AS free FROM b)
SELECT l_orderkey, i AS line, CAST(base + CASE WHEN n <= free THEN 1 ELSE 0 END AS BIGINT) AS part FROM r"""
)
def alloc_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    lines = folds.numbered(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]).select("l_orderkey", F.col("seq").alias("line"), F.col("l_quantity").cast("long").alias("weight"))
    totals = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("total"))
    return decimals.allocate(lines.join(totals, "l_orderkey"), ["l_orderkey"], "total", "weight", ["line"]).select("l_orderkey", "line", "part")


@registered(
    """WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS u FROM customer)
SELECT c_custkey, CAST(round(u / 100.0::DECIMAL(20,2), 1) * 10 AS BIGINT) AS away, CAST(round_even(u / 10, 0) AS BIGINT) AS even,
 CAST(sign(u) AS BIGINT) * ((abs(u) // 5) + CASE WHEN (abs(u) % 5) * 2 > 5 THEN 1 WHEN (abs(u) % 5) * 2 < 5 THEN 0 ELSE 1 END) * 5 AS cash FROM c"""
)
def money_rounding(spark: SparkSession, sf: str) -> DataFrame:
    units = cents("c_acctbal")
    amount = (units.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")
    return read(spark, sf, "customer").select(
        "c_custkey", (decimals.round_amount(amount, 1) * 10).cast("long").alias("away"), (decimals.round_amount(amount, 1, "half_even") * 10).cast("long").alias("even"), decimals.round_units(units, 5).alias("cash")
    )


@registered(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '0' || p_partkey WHEN 1 THEN p_partkey || '.50' WHEN 2 THEN '-' || p_partkey || '.125' WHEN 3 THEN '1e' || (p_partkey % 9) WHEN 4 THEN '+' || p_partkey WHEN 5 THEN p_partkey || '.' ELSE CAST(p_partkey AS VARCHAR) END AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(s, '-?(0|[1-9][0-9]*)(\.[0-9]+)?') AND NOT regexp_full_match(s, '-0(\.0+)?') AND length(regexp_extract(s, '\.([0-9]*?)0*$', 1)) <= 2 THEN CAST(CAST(CAST(s AS DECIMAL(20,3)) * 100 AS BIGINT) AS BIGINT) END AS cents FROM t"""
)
def money_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 7
    text = F.when(m == 0, F.concat(F.lit("0"), k)).when(m == 1, F.concat(k, F.lit(".50"))).when(m == 2, F.concat(F.lit("-"), k, F.lit(".125")))
    text = text.when(m == 3, F.concat(F.lit("1e"), (F.col("p_partkey") % 9).cast("string"))).when(m == 4, F.concat(F.lit("+"), k)).when(m == 5, F.concat(k, F.lit("."))).otherwise(k)
    return read(spark, sf, "part").select("p_partkey", (decimals.parse_amount(text, 2) * 100).cast("long").alias("cents"))


@registered("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS tokyo, CAST(ts - INTERVAL 5 HOUR AS DATE) AS new_york, CAST(ts + INTERVAL 345 MINUTE AS DATE) AS kathmandu FROM events")
def date_business(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    zones = {"tokyo": "Asia/Tokyo", "new_york": "America/New_York", "kathmandu": "Asia/Kathmandu"}
    return read(spark, sf, "events").select("event_id", *[calendar.business_date(at, zone).alias(name) for name, zone in zones.items()])


@registered(
    """WITH d AS (SELECT DATE '2024-01-01' + CAST(i AS INT) AS day FROM range(-1, 45) r(i)), s AS (SELECT day, h, m, day + to_hours(h) + to_minutes(m) AS wall FROM d, (VALUES (6), (18)) a(h), (VALUES (0), (15), (30), (45)) b(m)
 WHERE dayofmonth(day) IN (1, 11, 21, 31) OR dayofweek(day) = 0), j AS (SELECT s_suppkey AS job, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 10 AS INT)) AS after, TIMESTAMP '2024-01-25 12:00:00' + to_hours(s_suppkey % 50) AS until FROM supplier)
SELECT job, strftime(wall, '%Y-%m-%dT%H:%M') AS slot, strftime(wall - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS at, CASE WHEN row_number() OVER (PARTITION BY job ORDER BY wall) <= 24 THEN 'pending' ELSE 'paused' END AS state
FROM s JOIN j ON wall - INTERVAL 9 HOUR > after AND wall - INTERVAL 9 HOUR <= until"""
)
def cron_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Due slots of a job for each supplier, each with its own span since its last run."""
    k = F.col("s_suppkey")
    after = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval((k % 10).cast("int"))
    until = F.to_timestamp(F.lit("2024-01-25 12:00:00")) + F.make_dt_interval(F.lit(0), (k % 50).cast("int"))
    spans = read(spark, sf, "supplier").select(k.alias("job"), after.alias("after"), until.alias("until"))
    due = calendar.slots_between(spans, ["job"], "*/15 6,18 1,11,21,31 * 7", "Asia/Tokyo")
    return calendar.backfill(due, "all", "2024-01-31 12:00:00", by=("job",)).select("job", "slot", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "state")


# --- projections ------------------------------------------------------------------------------------------------


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as inputs of a projection: versions come out of order and repeat."""
    e = read(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "partial").otherwise("full")
    data = F.concat(F.lit('{"'), "event_type", F.lit('": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select(
        F.col("user_id").cast("string").alias("record_id"), kind.alias("kind"), ((F.col("event_id") * 37) % 1009).alias("version"), F.lit("impl-1").alias("impl"),
        F.when(F.col("event_id") % 50 == 49, "0.9").otherwise("1.0").alias("epoch"), data.alias("data"), F.col("event_id").alias("seq"), F.lit("users").alias("projection"),
    )


@registered(
    """WITH i AS (SELECT user_id, (event_id * 37) % 1009 AS v, event_type = 'error' AS gone FROM events WHERE event_type <> 'click' AND event_id % 50 <> 49),
t AS (SELECT user_id, max(v * 2 + CAST(gone AS INT)) AS top FROM i GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS record_id, CASE WHEN top % 2 = 1 THEN 'tombstone' ELSE 'complete' END AS state, top // 2 AS version FROM t"""
)
def fold_projection(spark: SparkSession, sf: str) -> DataFrame:
    source = spark.createDataFrame([("users", "impl-1", "1.0")], "projection string, impl string, epoch string")
    admitted = projection.admissible(inputs(spark, sf), source).where("skipped IS NULL AND kind <> 'partial'")
    return projection.fold_whole(admitted, ["record_id"])


@registered(
    """WITH RECURSIVE i AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'partial' ELSE 'full' END AS kind, (event_id * 37) % 1009 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 50 <> 49),
t AS (SELECT *, CASE kind WHEN 'full' THEN 'complete' WHEN 'partial' THEN 'incomplete' ELSE 'tombstone' END AS target FROM i),
r AS (SELECT user_id, n, target AS state, v AS version FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.n, CASE WHEN takes THEN target ELSE state END, CASE WHEN takes THEN v ELSE version END FROM (
    SELECT t.*, r.state, r.version, CASE WHEN r.state = 'tombstone' THEN t.v > r.version WHEN t.kind = 'full' THEN t.v > r.version OR (r.state = 'incomplete' AND t.v >= r.version) WHEN t.kind = 'partial' THEN t.v > r.version ELSE t.v >= r.version END AS takes
    FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1) t)
SELECT CAST(user_id AS VARCHAR) AS record_id, state, CAST(version AS BIGINT) AS version, CAST(CASE WHEN state = 'incomplete' THEN version END AS BIGINT) AS need_version FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r) WHERE n = m"""
)
def fold_projection_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return projection.fold_ordered(inputs(spark, sf).where("epoch = '1.0'"), ["seq"]).select("record_id", "state", "version", "need_version")


@registered(
    """WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'tombstone' ELSE 'complete' END AS state, c_custkey % 10 AS version, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS g FROM customer),
s AS (SELECT o_custkey AS id, min(o_orderkey % 12) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
r AS (SELECT id, CASE id % 5 WHEN 0 THEN 'purged' WHEN 1 THEN 'tombstone' ELSE 'exists' END AS a, id % 15 AS v FROM l WHERE g <> 2 AND id NOT IN (SELECT id FROM s)),
p AS (SELECT id, 'complete' AS ns, v AS nv FROM s UNION ALL SELECT id, CASE WHEN a = 'exists' THEN 'complete' ELSE 'tombstone' END, CASE WHEN a = 'purged' THEN 0 ELSE v END FROM r)
SELECT CAST(id AS VARCHAR) AS record_id, CASE WHEN k THEN ns ELSE state END AS state, CAST(CASE WHEN k THEN nv ELSE version END AS BIGINT) AS version, CASE WHEN k THEN 2 ELSE g END AS aligned_gen
FROM (SELECT *, nv IS NOT NULL AND (version IS NULL OR g <> 2 OR version < nv) AS k FROM l FULL JOIN p USING (id))"""
)
def fold_align(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = k.cast("string").alias("record_id")
    customer = read(spark, sf, "customer")
    local = customer.select(name, F.when(k % 3 == 0, "tombstone").otherwise("complete").alias("state"), (k % 10).alias("version"), F.when(k % 4 == 0, 2).otherwise(1).alias("aligned_gen"))
    snapshot = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").cast("string").alias("record_id")).agg(F.min(F.col("o_orderkey") % 12).alias("version"))
    answers = customer.select(name, F.when(k % 5 == 0, "purged").when(k % 5 == 1, "tombstone").otherwise("exists").alias("state"), (k % 15).alias("version"))
    return projection.aligned(local, snapshot, answers, 2)


@registered(
    """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 17 = 0 AS q FROM orders), r AS (SELECT l_orderkey AS id, CASE max(l_returnflag) WHEN 'R' THEN 'complete' WHEN 'N' THEN 'tombstone' ELSE 'incomplete' END AS s, max(l_linenumber) > 2 AS ad FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN q THEN 'unprovable' WHEN s IS NULL THEN 'provably_absent' WHEN NOT ad THEN 'unprovable' WHEN s = 'complete' THEN 'usable' WHEN s = 'tombstone' THEN 'provably_absent' ELSE 'unprovable' END AS verdict FROM a LEFT JOIN r USING (id)"""
)
def fold_judge(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 17 == 0).alias("quarantined"))
    flag = F.max("l_returnflag")
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(flag == "R", "complete").when(flag == "N", "tombstone").otherwise("incomplete").alias("state"), (F.max("l_linenumber") > 2).alias("adopted"))
    source = {"watermarked": F.lit(True), "state": F.lit("stalled"), "projection_serving": F.lit(True), "last_applied": F.lit(True), "age": F.lit(None).cast("double"), "freshness": F.lit(60.0)}
    return relations.judged(asked, rows, source)


# --- archive ----------------------------------------------------------------------------------------------------


@registered(
    "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS members, max(o_orderdate) AS anchor_max FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '2000-08-31' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) GROUP BY ALL"
)
def archive_candidates(spark: SparkSession, sf: str) -> DataFrame:
    members = read(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("root_id")).distinct()
    found = archive.candidates(read(spark, sf, "orders"), members, ORDERS, F.lit("2001-08-31").cast("timestamp_ntz"))
    return archive.groupings(found, ORDERS)


HISTORY_RESOURCE = policy.Resource({"priority": policy.Dimension("o_orderpriority"), "owner": policy.Dimension("o_custkey")}, {"o_orderkey": policy.ORDINARY, "o_orderdate": policy.ORDINARY, "o_custkey": policy.ORDINARY, "cents": policy.RESTRICTED})


@registered(
    f"""WITH {UNITS_SQL}, cold AS (SELECT root_id FROM members JOIN units USING (unit) WHERE state IN ('published', 'released'))
SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'cents' END AS masked
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def archive_history(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: one answer from online rows and cold units at a snapshot, whatever stage each unit is in."""
    units, members = sealed(spark, sf)
    routed = units.select("unit", F.when(F.col("state") == "sealed", "online").otherwise("object").alias("route"), F.when(F.col("state") == "sealed", 9).otherwise(1).alias("route_version"), "state")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", cents("o_totalprice").alias("cents"))
    copied = members.join(routed.where("route = 'object'").select("unit"), "unit", "left_semi")
    cold = orders.join(copied.withColumnRenamed("root_id", "o_orderkey"), "o_orderkey")
    online = archive.released(orders, "o_orderkey", members, units)
    since = "2000-01-01T00:00:00+00:00"
    names = ("o_orderkey", "o_orderdate", "o_custkey")
    segments = [
        policy.Segment("view", {"priority": policy.Atom("in", values=("1-URGENT", "2-HIGH")), "owner": ALL}, names, since),
        policy.Segment("view", {"priority": policy.Atom("in", values=("2-HIGH",)), "owner": ALL}, (*names, "cents"), since),
    ]
    plan = policy.compile_plan(HISTORY_RESOURCE, segments, "view", PRINCIPAL, NOW)
    rows = archive.history(online, cold, ORDERS, members, routed, 5, HISTORY_RESOURCE, plan)
    return rows.withColumn("masked", F.array_join(policy.MASKED, ",")).drop(policy.MASKED)


@registered(
    """WITH m AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM m) THEN NULL ELSE l_returnflag END AS l_returnflag, CAST(l_quantity AS INT) AS quantity FROM lineitem"""
)
def erased_columns(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("root_id"))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity"))
    return archive.erased(rows, "l_orderkey", ids, ("l_returnflag",))


@registered(
    f"""WITH {UNITS_SQL}, r AS (SELECT m.unit, '["' || o_orderkey || '"]' AS pk, '{{"code":"' || o_orderpriority || '","day":"' || strftime(o.o_orderdate, '%Y-%m-%d') || '","id":"' || o_orderkey || '","total":"' || CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN (c // 100) || '.' || (c % 100 // 10) ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END || '"}}' AS row
FROM members m JOIN (SELECT o_orderkey, o_orderpriority, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) o ON o.o_orderkey = root_id)
SELECT unit, count(*) AS rows, sha256(unhex(string_agg(lpad(printf('%X', octet_length(CAST(row AS BLOB))), 16, '0') || hex(CAST(row AS BLOB)), '' ORDER BY pk))) AS sha256 FROM r GROUP BY unit"""
)
def digest_unit(spark: SparkSession, sf: str) -> DataFrame:
    _, members = sealed(spark, sf)
    amount = (cents("o_totalprice").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")
    rows = read(spark, sf, "orders").join(members.withColumnRenamed("root_id", "o_orderkey"), "o_orderkey").select("unit", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("day"), amount.alias("total"))
    kinds = {"id": "bigint", "code": "text", "day": "date", "total": "numeric"}
    return canonical.table_hash(archive.canonical_rows(rows, kinds, ["id"]), ["unit"], "pk", "row")


@registered(
    f"""WITH {UNITS_SQL}, e AS (SELECT split_part(unit, '~', 1) AS code, * FROM units), w AS (SELECT unit, list_filter([CASE WHEN members % 3 = 0 THEN 'held' END, CASE WHEN members % 2 = 0 THEN 'approval' END], lambda x: x IS NOT NULL) AS d,
 list_filter([CASE WHEN members % 4 = 0 THEN 'lease' END, CASE WHEN members % 5 = 0 THEN 'no_backup' END, CASE WHEN anchor_max > TIMESTAMP '1998-12-15' THEN 'recent_records' END], lambda x: x IS NOT NULL) AS r, * FROM e)
SELECT unit, CASE WHEN code = '5-LOW' THEN 'none' WHEN anchor_max < TIMESTAMP '1995-06-01' THEN CASE WHEN len(d) = 0 THEN 'destroy' ELSE 'none' END WHEN state = 'sealed' THEN CASE WHEN code = '1-URGENT' THEN 'none' ELSE 'transfer' END WHEN state = 'published' THEN CASE WHEN len(r) = 0 THEN 'release' ELSE 'none' END ELSE 'none' END AS action,
 CASE WHEN code = '5-LOW' THEN 'not_tierable' WHEN anchor_max < TIMESTAMP '1995-06-01' THEN array_to_string(list_sort(d), ',') WHEN state = 'sealed' AND code = '1-URGENT' THEN 'immutable_route' WHEN state = 'published' THEN array_to_string(list_sort(r), ',') ELSE '' END AS reasons FROM w"""
)
def archive_plan(spark: SparkSession, sf: str) -> DataFrame:
    from recordloom.operators.decisions import archive_plan as decide

    units, _ = sealed(spark, sf)
    code, n = F.split_part("unit", F.lit("~"), F.lit(1)), F.col("members")
    unit = {
        "category": F.when(code == "5-LOW", "master").otherwise("completed"), "residence_days": F.lit(365), "retention_pending": F.lit(False), "erasable": F.lit(True), "state": F.col("state"), "anchor_max": F.col("anchor_max").cast("timestamp"),
        "blockers": F.array().cast("array<string>"), "immutable_route": code == "1-URGENT", "published_at": F.lit("1990-01-01").cast("timestamp"), "newest_created": F.col("anchor_max").cast("timestamp"),
        "old_leases": F.when(n % 4 == 0, 1).otherwise(0), "backed_up": n % 5 != 0, "retention_due": F.col("anchor_max") < F.lit("1995-06-01").cast("timestamp_ntz"), "approved": n % 2 != 0, "holds": F.when(n % 3 == 0, 1).otherwise(0),
    }
    told = decide(F.lit("1999-01-15").cast("timestamp"), F.lit(31 * 86_400), F.lit(3_600), unit)
    return units.select("unit", told.alias("told")).select("unit", "told.action", F.array_join("told.reasons", ",").alias("reasons"))


@registered(
    f"""WITH {UNITS_SQL}, c AS (SELECT unit, CASE WHEN members % 2 = 0 THEN 'object' ELSE 'warm' END AS route, members AS rows, 'o/' || unit AS path, members * 100 AS size FROM units),
l AS (SELECT path, CASE WHEN rows % 7 = 0 THEN size + 1 ELSE size END AS found FROM c WHERE rows % 6 <> 0 UNION ALL SELECT 'o/stray', 5), w AS (SELECT unit, CASE WHEN rows % 5 = 0 THEN rows - 1 ELSE rows END AS found FROM c WHERE rows % 3 <> 0)
SELECT 'missing_object' AS kind, c.path AS id, unit AS detail FROM c LEFT JOIN l USING (path) WHERE route = 'object' AND found IS NULL
UNION ALL SELECT 'other_size', c.path, found || '/' || size FROM c JOIN l USING (path) WHERE route = 'object' AND found <> size
UNION ALL SELECT 'stray_object', path, '' FROM l WHERE path NOT IN (SELECT path FROM c WHERE route = 'object')
UNION ALL SELECT 'warm_rows', unit, coalesce(found, 0) || '/' || rows FROM c LEFT JOIN w USING (unit) WHERE route = 'warm' AND coalesce(found, 0) <> rows"""
)
def catalog_differences(spark: SparkSession, sf: str) -> DataFrame:
    from recordloom.sources.archive import differences

    units, _ = sealed(spark, sf)
    n = F.col("rows")
    catalog = units.select("unit", F.when(F.col("members") % 2 == 0, "object").otherwise("warm").alias("route"), F.lit(1).alias("version"), F.col("members").alias("rows"), F.concat(F.lit("o/"), "unit").alias("path"), (F.col("members") * 100).alias("size"))
    listing_ = catalog.where(n % 6 != 0).select("path", F.when(n % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size")).unionByName(spark.createDataFrame([("o/stray", 5)], "path string, size long"))
    warm = catalog.where(n % 3 != 0).select("unit", "version", F.when(n % 5 == 0, n - 1).otherwise(n).alias("rows"))
    return differences(catalog, listing_, warm)


@registered(
    """WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'received' END AS st, CASE event_id % 5 WHEN 0 THEN '1.0' WHEN 1 THEN '2.0' WHEN 2 THEN '3.0' WHEN 3 THEN '4.0' ELSE '1.7' END AS ep, event_id % 3000 AS sq, ts FROM events)
SELECT event_id, CASE WHEN st <> 'received' THEN 'keep' WHEN ep = '3.0' THEN CASE WHEN sq <= 1500 AND ts < TIMESTAMP '2024-01-21' THEN 'delete' ELSE 'keep' END WHEN ep = '2.0' AND sq > 1000 THEN 'resend' WHEN ep = '1.0' AND sq > 2000 THEN 'resend'
 WHEN ep IN ('1.0', '2.0') THEN CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'delete' ELSE 'keep' END WHEN ep = '4.0' THEN 'keep' ELSE 'resend' END AS settled FROM r"""
)
def audit_purge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    epoch = F.when(k == 0, "1.0").when(k == 1, "2.0").when(k == 2, "3.0").when(k == 3, "4.0").otherwise("1.7")
    rows = read(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("received").alias("transfer_state"), epoch.alias("receipt_epoch"), (F.col("event_id") % 3000).alias("receipt_seq"), F.col("ts").alias("received_at"))
    ancestors = spark.createDataFrame([("1.0", 2000), ("2.0", 1000)], "epoch string, fork_seq long")
    return folds.receipts_settled(rows, "3.0", 1500, ancestors, True, F.lit("2024-01-31").cast("timestamp_ntz"), F.expr("INTERVAL 10 DAYS")).select("event_id", "settled")


@registered(
    """WITH RECURSIVE n AS (SELECT user_id % 50 AS principal, event_type AS key, event_id, ts, event_id % 3 AS f, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT *, ts AS s, f AS p, 'runs' AS outcome FROM n WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN n.ts - r.s >= INTERVAL 24 HOUR THEN n.ts ELSE r.s END, CASE WHEN n.ts - r.s >= INTERVAL 24 HOUR THEN n.f ELSE r.p END, CASE WHEN n.ts - r.s >= INTERVAL 24 HOUR THEN 'runs' WHEN n.f = r.p THEN 'replays' ELSE 'conflicts' END
  FROM r JOIN n ON n.principal = r.principal AND n.key = r.key AND n.i = r.i + 1)
SELECT principal, key, event_id, outcome FROM r"""
)
def idempotent_commands(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select((F.col("user_id") % 50).alias("principal"), "event_type", F.col("ts").alias("at"), "event_id")
    commands = e.select("principal", F.col("event_type").alias("key"), "at", "event_id", (F.col("event_id") % 3).cast("string").alias("fingerprint"))
    return folds.idempotent(commands, ["at", "event_id"]).select("principal", "key", "event_id", "outcome")


@registered("SELECT 'inv/' || c_nationkey AS series, c_custkey, 500 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS number FROM customer")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    series = F.concat(F.lit("inv/"), F.col("c_nationkey").cast("string"))
    requests = read(spark, sf, "customer").select(series.alias("series"), "c_custkey")
    used = requests.select("series").distinct().withColumn("max_used", F.lit(500).cast("long"))
    return folds.dense_numbers(requests, ["series"], ["c_custkey"], used)


from recordloom.plans import cold as _cold  # noqa: E402, F401  registers its queries
from recordloom.plans import kept as _kept  # noqa: E402, F401  registers its queries
from recordloom.plans import more as _more  # noqa: E402, F401  registers its queries
from recordloom.plans import operated as _operated  # noqa: E402, F401  registers its queries
from recordloom.plans import recovery as _recovery  # noqa: E402, F401  registers its queries
from recordloom.plans import sealed as _sealed  # noqa: E402, F401  registers its queries
from recordloom.plans import streams as _streams  # noqa: E402, F401  registers its queries
from recordloom.plans import tables as _tables  # noqa: E402, F401  registers the decision tables
from recordloom.plans import values as _values  # noqa: E402, F401  registers its queries
