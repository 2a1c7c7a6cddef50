"""Queries of what is kept, claimed, admitted and refused, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import decimals
from recordloom.operators import decisions, policy
from recordloom.plans import archive
from recordloom.plans.queries import OUTBOX, UNITS_SQL, cents, outbox, registered, sealed
from recordloom.sources import archive as files
from recordloom.sources.tables import read
from recordloom.streaming import inbox, projection

NTZ = "timestamp_ntz"


@registered(f"WITH {UNITS_SQL} SELECT unit, count(*) AS rows FROM members JOIN units USING (unit) WHERE state = 'released' AND root_id % 5 = 0 GROUP BY unit")
def released_left_online(spark: SparkSession, sf: str) -> DataFrame:
    """Released units that still have online rows: a fifth of the orders was not deleted."""
    units, members = sealed(spark, sf)
    return archive.left_online(read(spark, sf, "orders").where("o_orderkey % 5 = 0"), "o_orderkey", members, units)


@registered(
    "SELECT l_orderkey AS unit, CAST(l_linenumber AS INT) AS version, count(*) AS rows FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 4 + 1 = l_linenumber) GROUP BY 1, 2"
)
def orphan_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of versions that no manifest names, older than a running transfer may be."""
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("int").alias("version"), F.col("l_shipdate").cast(NTZ).alias("written_at"))
    manifests = read(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 4 + 1).cast("int").alias("version"))
    found = files.orphan_rows(rows, manifests, F.lit("2000-01-02").cast(NTZ), 24)
    return found.groupBy("unit", "version").agg(F.count("*").alias("rows"))


@registered(
    """SELECT event_id, octet_length(CAST(props AS BLOB)) > 8 AS claimed, CASE WHEN octet_length(CAST(props AS BLOB)) > 8 THEN event_id % 9 > 1 END AS ok,
 CASE WHEN octet_length(CAST(props AS BLOB)) <= 8 OR event_id % 9 > 1 THEN sha256(props) END AS content FROM events"""
)
def claims_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Large payloads go to a store and come back by their claims; some are lost there, some have another content."""
    events = read(spark, sf, "events").select("event_id", F.encode("props", "UTF-8").alias("payload"))
    told = files.claim_checked(events.withColumn("event_id", F.col("event_id").cast("string")), "store://claims", 8)
    n = F.col("event_id") % 9
    large = events.where((F.length("payload") > 8) & (n != 0))  # one in nine is not there
    store = large.select(F.concat(F.lit("store://claims/"), F.col("event_id").cast("string")).alias("uri"), F.when(n == 1, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("payload")).alias("content"))
    back = files.resolved(told, store)
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("claim").isNotNull().alias("claimed"), F.col("claim_ok").alias("ok"), F.sha2("payload", 256).alias("content"))


@registered("SELECT CAST(event_id AS VARCHAR) AS causation, event_id % 14 + 1 AS hops FROM events WHERE event_id % 14 + 1 <= 10")
def hops_admitted(spark: SparkSession, sf: str) -> DataFrame:
    """Events that follow from others, as long as their chain is not too long."""
    events = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), (F.col("event_id") % 14).alias("hops"))
    return inbox.admitted(inbox.caused(events)).select("causation", "hops")


@registered("SELECT event_type, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY event_type")
def log_retained(spark: SparkSession, sf: str) -> DataFrame:
    rows = projection.retained(read(spark, sf, "events").withColumn("ts", F.col("ts").cast(NTZ)), "ts", F.lit("2024-01-31").cast(NTZ), 10)
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"))


@registered(
    f"""WITH {OUTBOX}, n AS (SELECT *, row_number() OVER (PARTITION BY partition, generation ORDER BY event_id) AS seq FROM outbox)
SELECT event_id, partition FROM n WHERE partition % 3 = 2 OR (partition % 3 = 1 AND generation >= 2) OR (partition % 3 = 0 AND (generation > 1 OR seq > 20))"""
)
def resent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after each partition's start; a third of the partitions starts in the second epoch, a third has no start."""
    from recordloom.operators import folds

    rows = folds.numbered(outbox(spark, sf), ["partition", "generation"], ["event_id"]).withColumn("stream", F.lit("users"))
    rows = rows.withColumn("position", F.struct("generation", F.col("seq").alias("seq")))
    parts = spark.range(8).select(F.col("id").cast("int").alias("partition"))
    start = F.when(parts.partition % 3 == 1, F.struct(F.lit(2).cast("long").alias("generation"), F.lit(0).cast("long").alias("seq"))).otherwise(F.struct(F.lit(1).cast("long").alias("generation"), F.lit(20).cast("long").alias("seq")))
    starts = parts.where("partition % 3 <> 2").select(F.lit("users").alias("stream"), "partition", start.alias("position"))
    return projection.resent(rows, starts).select("event_id", "partition")


@registered(
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS two, CAST(c AS VARCHAR) || '.000' AS three FROM c"""
)
def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as texts with exactly so many places."""
    units = F.when(F.col("o_orderkey") % 2 == 0, -cents("o_totalprice")).otherwise(cents("o_totalprice")).cast("decimal(20,0)")
    hundredths = (units / F.lit(100).cast("decimal(3,0)")).cast("decimal(22,2)")
    return read(spark, sf, "orders").select("o_orderkey", decimals.format_amount(hundredths, 2).alias("two"), decimals.format_amount(units, 3).alias("three"))


@registered(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NOT_FOUND' WHEN o_custkey % 3 = 0 THEN 'PERMISSION_DENIED' WHEN o_orderkey % 3 = 1 OR o_custkey % 3 = 1 THEN 'AUTHORIZATION_UNPROVABLE' END AS why FROM orders"""
)
def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Why each order is refused: what can't be told counts only where nothing is known against it."""
    def known(column: str):
        return F.when(F.col(column) % 3 == 0, F.lit(False)).when(F.col(column) % 3 == 2, F.lit(True))

    return read(spark, sf, "orders").select("o_orderkey", policy.decision_error(known("o_orderkey"), known("o_custkey")).alias("why"))


@registered("SELECT event_id, ts < TIMESTAMP '2024-01-10' OR event_id % 4 <> 2 AS reset FROM events")
def clocks_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a clock went back, or belongs to another epoch."""
    epoch = (F.col("event_id") % 4).cast("string")
    return read(spark, sf, "events").select("event_id", decisions.clock_reset(F.col("ts").cast(NTZ), F.lit("2024-01-10").cast(NTZ), epoch, F.lit("2")).alias("reset"))
