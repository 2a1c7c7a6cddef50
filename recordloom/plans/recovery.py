"""Queries of recovery checks, redelivery, views of grants, archive units and exports over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import recovery
from recordloom.plans.queries import registered
from recordloom.sources.tables import read

NTZ = "timestamp_ntz"


def text(column: Column) -> Column:
    return column.cast("string")


@registered(
    """SELECT 'c' || c_custkey AS consumer, CAST(c_nationkey % 3 AS INT) AS generation, CAST(c_custkey % 2 AS INT) AS timeline,
 c_custkey % 7 <> 0 AND (c_custkey % 5 % 3 <> c_nationkey % 3 OR c_custkey % 4 % 2 <> c_custkey % 2) AS back FROM customer"""
)
def consumers_back(spark: SparkSession, sf: str) -> DataFrame:
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("c"), text(k)).alias("consumer")
    current = c.select(name, (F.col("c_nationkey") % 3).cast("int").alias("generation"), (k % 2).cast("int").alias("timeline"))
    recorded = c.where("c_custkey % 7 <> 0").select(name, (k % 5 % 3).cast("int").alias("generation"), (k % 4 % 2).cast("int").alias("timeline"))
    return recovery.went_back(recorded, current)


GAPS_SQL = """a AS (SELECT n_name AS stream, CAST(unnest([n_nationkey % 4, n_nationkey % 4 + 4]) AS INT) AS partition, unnest(['beyond_retention', 'ahead']) AS kind FROM nation),
s AS (SELECT 'sub-' || s_suppkey AS subscription, n_name AS stream, s_suppkey % 3 = 0 AS repairs FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT subscription, stream, CAST(unnest([0, 2, 5]) AS INT) AS partition, length(subscription) + 100 AS progress FROM s WHERE repairs),
gaps AS (SELECT subscription, stream, partition, kind, CAST(progress AS BIGINT) AS progress, kind = 'beyond_retention' AND repairs AS repair FROM a JOIN s USING (stream) LEFT JOIN p USING (subscription, stream, partition))"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    nation, n = read(spark, sf, "nation"), F.col("n_nationkey")
    answers = nation.select(F.col("n_name").alias("stream"), F.array((n % 4).cast("int")).alias("beyond_retention"), F.array((n % 4 + 4).cast("int")).alias("ahead"))
    readers = read(spark, sf, "supplier").join(nation, n == F.col("s_nationkey"))
    subs = readers.select(F.concat(F.lit("sub-"), text(F.col("s_suppkey"))).alias("subscription"), F.col("n_name").alias("stream"), (F.col("s_suppkey") % 3 == 0).alias("repairs"))
    reached = subs.where("repairs").select("subscription", "stream", F.explode(F.array(*[F.lit(x) for x in (0, 2, 5)])).alias("partition"), (F.length("subscription") + 100).cast("long").alias("progress"))
    return recovery.resend_gaps(answers, subs, reached)


@registered(f"WITH {GAPS_SQL} SELECT * FROM gaps")
def redelivery_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(spark, sf)


@registered(
    f"""WITH {GAPS_SQL} SELECT 'projection' AS object_type, 'p' || n_nationkey AS object_id, 'source ' || CASE n_nationkey % 3 WHEN 1 THEN 'behind' ELSE 'unknown' END AS detail FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'projection_subject', event_type || '/u' || user_id, 'quarantined: ' || count(*) || ' events' FROM events WHERE event_id % 10 = 0 GROUP BY event_type, user_id
UNION ALL SELECT 'consumer_epoch', c_nationkey || '.2', 'the redelivery has not answered' FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'resend_gap', subscription || ':' || stream || '/' || partition, kind || coalesce(' after ' || progress, '') FROM gaps
UNION ALL SELECT 'audit_backlog', 'pending', count(*) || ' records not transferred, the oldest at ' || strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') FROM orders WHERE o_orderstatus = 'O' HAVING count(*) > 0
UNION ALL SELECT 'audit_backlog', 'conflict', count(*) || ' records in conflict' FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0"""
)
def recovery_differences(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps a recovery from being confirmed, over all projections, quarantines, epochs, gaps and audit records."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    sources = read(spark, sf, "nation").select(F.concat(F.lit("p"), text(n)).alias("projection"), F.when(n % 3 == 0, "aligned").when(n % 3 == 1, "behind").otherwise("unknown").alias("status"))
    held = read(spark, sf, "events").where("event_id % 10 = 0").select(F.col("event_type").alias("projection"), F.concat(F.lit("u"), text(F.col("user_id"))).alias("subject"))
    c = read(spark, sf, "customer")
    current = c.select(k.alias("consumer"), F.col("c_nationkey").alias("generation"), F.lit(2).alias("timeline"))
    recorded = c.where("c_custkey % 7 <> 0").select(k.alias("consumer"), F.col("c_nationkey").alias("generation"), F.lit(1).alias("timeline"))
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "conflict").otherwise("received")
    audits = read(spark, sf, "orders").select(state.alias("transfer_state"), F.col("o_orderdate").alias("occurred_at"))
    return recovery.differences(sources, held, recovery.went_back(recorded, current), gaps(spark, sf), audits)


@registered(
    """SELECT 'r' || l.rowid_ AS reference, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS command, l_shipmode_ AS conclusion, coalesce(CASE WHEN l_linenumber % 5 <> 0 THEN o_orderstatus END, CASE WHEN l_linenumber % 2 = 0 THEN 'kept' END, '') AS state
FROM (SELECT *, l_orderkey || '-' || l_linenumber AS rowid_, l_returnflag AS l_shipmode_ FROM lineitem) l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey = l_orderkey"""
)
def recovery_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    kept = read(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), text(order), F.lit("-"), text(line)).alias("reference"), F.when(line % 5 != 0, text(order)).alias("command"), F.col("l_returnflag").alias("conclusion"), F.when(line % 2 == 0, "kept").alias("state")
    )
    commands = read(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(text(F.col("o_orderkey")).alias("command"), F.col("o_orderstatus").alias("state"))
    return recovery.conclusions(kept, commands)


@registered(
    """WITH d AS (SELECT 'd' || user_id AS durable, event_id AS seq, event_id % 5 AS attempts, event_type IN ('click', 'view') AS in_flight, ts FROM events),
n AS (SELECT durable, seq, attempts, row_number() OVER (PARTITION BY durable ORDER BY seq) AS p FROM d WHERE (NOT in_flight AND ts <= TIMESTAMP '2024-01-20') OR (in_flight AND ts < TIMESTAMP '2024-01-20' AND attempts < 3))
SELECT durable, n.seq, attempts + 1 AS attempts, event_type AS subject FROM n LEFT JOIN events e ON e.event_id = n.seq AND e.event_id % 4 <> 0 WHERE p = 1"""
)
def deliveries_due(spark: SparkSession, sf: str) -> DataFrame:
    """The next delivery of every durable, its message if it is still kept."""
    e, seq = read(spark, sf, "events"), F.col("event_id").alias("seq")
    deliveries = e.select(F.concat(F.lit("d"), text(F.col("user_id"))).alias("durable"), seq, (F.col("event_id") % 5).alias("attempts"), F.col("event_type").isin("click", "view").alias("in_flight"), F.col("ts").alias("not_before"), F.col("ts").alias("lease_until"))
    messages = e.where("event_id % 4 <> 0").select(seq, F.col("event_type").alias("subject"))
    return recovery.due_deliveries(deliveries, messages, F.lit("2024-01-20").cast(NTZ), 3)


@registered(
    """SELECT 'v' || c_nationkey AS view, bool_or(coalesce((c_custkey % 3, c_custkey % 11) < (c_custkey % 4, 10) OR (c_custkey % 3 = c_custkey % 4 AND c_custkey % 11 = 10 AND c_custkey % 5 <> 0 AND c_custkey % 9 < 6), FALSE) AND c_custkey % 2 = 0) AS back FROM customer GROUP BY c_nationkey"""
)
def views_regressed(spark: SparkSession, sf: str) -> DataFrame:
    """Views whose next revisions go back; one domain for each customer, timelines compared as integers."""
    k, c = F.col("c_custkey"), read(spark, sf, "customer")
    view, domain = F.concat(F.lit("v"), text(F.col("c_nationkey"))).alias("view"), k.alias("domain")
    held = c.where("c_custkey % 2 = 0").select(view, domain, F.concat(text(k % 4), F.lit(".10")).alias("epoch"), F.lit("6").alias("value"))
    following = c.select(view, domain, F.concat(text(k % 3), F.lit("."), text(k % 11)).alias("epoch"), F.when(k % 5 == 0, "none").otherwise(text(k % 9)).alias("value"))
    return recovery.regressed(held, following)


@registered(
    """WITH v AS (SELECT n_nationkey AS view, unnest(list_distinct(['t' || n_nationkey % 7, 't' || n_nationkey % 6])) AS resource_type, CAST(n_nationkey * 3 AS DOUBLE) AS sent_at, CASE WHEN n_nationkey % 4 <> 1 THEN CAST(n_nationkey * 3 AS DOUBLE) END AS high_at, n_nationkey % 8 = 3 AS stopped, n_nationkey % 5 <> 0 AS stale FROM nation),
l AS (SELECT o_orderkey AS lookup, 'u' || o_custkey % 40 AS principal, 't' || o_orderkey % 8 AS resource_type, o_orderstatus = 'F' AS high, o_orderpriority = '1-URGENT' AS tight, CAST(o_orderkey % 90 AS DOUBLE) AS moment FROM orders),
j AS (SELECT lookup, principal, l.resource_type, min(CASE WHEN NOT stopped AND moment < CASE WHEN high THEN high_at + 5 * (1 - 0.001) ELSE sent_at + 30 * (1 - 0.001) END THEN view WHEN NOT stopped AND tight AND stale AND high_at IS NOT NULL THEN 1000 + view END) AS best FROM l LEFT JOIN v USING (resource_type) GROUP BY ALL),
s AS (SELECT n_nationkey AS view, 'u' || u AS principal, (n_nationkey + u) % 6 = 0 AS disabled, CAST(n_nationkey * u AS BIGINT) AS ver FROM nation, range(0, 40) t(u) WHERE (n_nationkey + u) % 9 <> 0)
SELECT lookup, CASE WHEN best >= 1000 THEN 'stale' WHEN best IS NULL THEN 'expired' ELSE 'valid' END AS outcome, CAST(best % 1000 AS INT) AS view,
 CASE WHEN NOT disabled THEN 'all' || CASE WHEN resource_type = 't3' THEN ',three' ELSE '' END ELSE '' END AS segments, coalesce(ver, 0) AS security_version FROM (SELECT *, best % 1000 AS view FROM j) LEFT JOIN s USING (view, principal)"""
)
def grants_found(spark: SparkSession, sf: str) -> DataFrame:
    """One lookup of grants for each order: valid, stale or expired views, accounts without segments."""
    n, o = F.col("n_nationkey"), F.col("o_orderkey")
    nation = read(spark, sf, "nation")
    kind = F.array(F.concat(F.lit("t"), text(n % 7)), F.concat(F.lit("t"), text(n % 6)))
    views = nation.select(
        n.cast("int").alias("view"), kind.alias("applicability"), (n * 3).cast("double").alias("sent_at"), F.when(n % 4 != 1, (n * 3).cast("double")).alias("high_at"), (n % 8 == 3).alias("stopped"), F.lit(False).alias("suspended"),
        (n % 5 != 0).alias("source_stale"),
    )
    lookups = read(spark, sf, "orders").select(
        o.alias("lookup"), F.concat(F.lit("u"), text(F.col("o_custkey") % 40)).alias("principal"), F.concat(F.lit("t"), text(o % 8)).alias("resource_type"), F.when(F.col("o_orderstatus") == "F", "high").otherwise("ordinary").alias("risk"),
        (F.col("o_orderpriority") == "1-URGENT").alias("tightening"), (o % 90).cast("double").alias("at"),
    )
    each = nation.select(n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("u")).where("(n + u) % 9 <> 0")
    segment = F.array(*[F.struct(F.lit(t).alias("resource_type"), F.lit(s).alias("name")) for t, s in (("t3", "three"), ("", "all"))])
    subjects = each.select(F.col("n").cast("int").alias("view"), F.concat(F.lit("u"), text(F.col("u"))).alias("principal"), ((F.col("n") + F.col("u")) % 6 == 0).alias("disabled"), segment.alias("segments"), (F.col("n") * F.col("u")).cast("long").alias("security_version"))
    return recovery.grants(lookups, views, subjects).withColumn("segments", F.array_join("segments", ","))


@registered(
    """SELECT 'u' || c_custkey AS unit, CASE WHEN a IS NOT NULL THEN coalesce(CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1995-01-01' END, a + INTERVAL 90 DAY) END AS blocked_since
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c_custkey"""
)
def units_blocked_since(spark: SparkSession, sf: str) -> DataFrame:
    """Since when each unit (the orders of a customer) is blocked by open orders."""
    k = F.col("c_custkey")
    units = read(spark, sf, "customer").select(F.concat(F.lit("u"), text(k)).alias("unit"), F.when(k % 3 == 0, F.lit("1995-01-01").cast(NTZ)).alias("blocked_since"))
    anchors = read(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("u"), text(F.col("o_custkey"))).alias("unit"), F.col("o_orderdate").cast(NTZ).alias("anchor"))
    return recovery.blocked_since(units, anchors, 90)


@registered(
    """WITH w AS (SELECT DISTINCT o_orderpriority AS class, CAST(year(o_orderdate) AS VARCHAR) || '-' || o_custkey % 9 AS grouping FROM orders),
u AS (SELECT o_orderpriority AS class, CAST(year(o_orderdate) AS VARCHAR) || '-' || o_custkey % 9 AS grouping, count(*) AS seq, max(o_orderkey) % 4 = 0 AS open FROM orders WHERE o_custkey % 9 <> 4 GROUP BY ALL)
SELECT class, grouping, CASE WHEN open THEN seq ELSE coalesce(seq, 0) + 1 END AS seq, NOT coalesce(open, FALSE) AS created FROM w LEFT JOIN u USING (class, grouping)"""
)
def units_opened(spark: SparkSession, sf: str) -> DataFrame:
    """The open unit of every class and grouping of the orders, or the next number."""
    orders = read(spark, sf, "orders").withColumn("class", F.col("o_orderpriority"))
    orders = orders.withColumn("grouping", F.concat_ws("-", text(F.year("o_orderdate")), text(F.col("o_custkey") % 9)))
    known = orders.where("o_custkey % 9 <> 4").groupBy("class", "grouping").agg(F.count("*").alias("seq"), F.when(F.max("o_orderkey") % 4 == 0, "open").otherwise("sealed").alias("state"))
    return recovery.open_units(orders, known)


@registered(
    """SELECT o_orderkey AS export, 'p' || o_custkey % 3 AS principal, CASE WHEN ok THEN o_orderstatus END AS state, CASE WHEN ok THEN CAST(o_custkey AS BIGINT) END AS rows
FROM (SELECT *, o_custkey % 3 = o_orderkey % 4 AND (o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1996-06-01') AS ok FROM orders)"""
)
def exports_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every order's export, asked for by someone who may not be its requester."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    exports = o.select(k.alias("export"), F.concat(F.lit("p"), text(k % 4)).alias("principal"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("long").alias("rows"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("expires_at"))
    asked = o.select(k.alias("export"), F.concat(F.lit("p"), text(F.col("o_custkey") % 3)).alias("principal"))
    return recovery.export_status(asked, exports, F.lit("1996-06-01").cast(NTZ))


@registered("SELECT o_orderkey AS export FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate <= TIMESTAMP '1996-06-01'")
def exports_expired(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    exports = read(spark, sf, "orders").select(k.alias("export"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("expires_at"))
    return recovery.expired_exports(exports, F.lit("1996-06-01").cast(NTZ)).select("export")


@registered(
    """SELECT o_orderkey AS root_id, CASE WHEN o_orderkey % 6 = 0 THEN 'not_here' WHEN o_custkey % 10 = 1 THEN 'destroyed' WHEN o_custkey % 10 = 2 THEN 'not_here' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'found' ELSE 'unavailable' END AS outcome,
 CASE WHEN o_orderkey % 6 <> 0 THEN 'u' || o_custkey END AS unit FROM orders"""
)
def archive_located(spark: SparkSession, sf: str) -> DataFrame:
    """Where each order is answered: destroyed, not in the archive, found in its unit's copy, or unavailable."""
    orders, c = read(spark, sf, "orders"), F.col("c_custkey")
    asked = orders.select(F.col("o_orderkey").alias("root_id"))
    members = orders.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("root_id"), F.concat(F.lit("u"), text(F.col("o_custkey"))).alias("unit"))
    state = F.when(c % 10 == 1, "destroyed").otherwise("released")
    units = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().select(F.concat(F.lit("u"), text(c)).alias("unit"), state.alias("state"), F.when(c % 10 == 2, "online").otherwise("object").alias("route"))
    copies = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("root_id")).distinct().join(members, "root_id")
    return recovery.located(asked, members, units, copies)


@registered(
    """SELECT event_id AS run, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'done' END AS state, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 4 END AS attempts, CASE WHEN event_type <> 'view' THEN props END AS progress,
 CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-03-01' + to_seconds(event_id % 600) END AS run_at, CASE WHEN event_type <> 'view' THEN TIMESTAMP '2024-03-01' END AS finished_at FROM events"""
)
def runs_completed(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    runs = read(spark, sf, "events").select(i.alias("run"), (F.col("event_type") == "view").alias("singleton"), (i % 600).alias("interval_s"), (i % 4).alias("attempts"), F.col("props").alias("progress"))
    return recovery.completed(runs, F.lit("2024-03-01").cast(NTZ))
