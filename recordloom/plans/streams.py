"""Queries of numbered streams, redeliveries, watermark alignment and its tripwires, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.queries import registered
from recordloom.sources.tables import read
from recordloom.streaming import delivery, projection


def text(column: Column) -> Column:
    return column.cast("string")


@registered(
    """WITH e AS (SELECT (user_id % 8)::INT AS partition, (event_id // 300 + 1) || '.0' AS epoch, event_id AS ord FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY partition, epoch ORDER BY ord) AS seq FROM e),
r AS (SELECT partition, epoch, min(ord) AS first, count(*) AS n FROM e GROUP BY partition, epoch), f AS (SELECT partition, epoch, lag(epoch) OVER w AS old_epoch, lag(n) OVER w AS fork_seq FROM r WINDOW w AS (PARTITION BY partition ORDER BY first))
SELECT 'row' AS kind, partition, epoch, ord, seq, NULL AS old_epoch, NULL AS fork_seq FROM n UNION ALL SELECT 'fork', partition, epoch, NULL, NULL, old_epoch, fork_seq FROM f WHERE old_epoch IS NOT NULL"""
)
def stream_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of eight partitions, numbered within epochs, with the fork of every change."""
    e = read(spark, sf, "events")
    rows = e.select((F.col("user_id") % 8).cast("int").alias("partition"), F.concat(text(F.expr("event_id div 300 + 1")), F.lit(".0")).alias("epoch"), F.col("event_id").alias("ord"))
    return delivery.numbered_batch(rows)


@registered(
    """WITH d AS (SELECT event_id, event_id % 5 AS f, unnest(generate_series(1, least(event_id % 5 + 1, 3))) AS attempt, ts FROM events),
t AS (SELECT event_id, attempt::INT AS attempt, CASE WHEN attempt > f THEN 'ack' WHEN attempt >= 3 THEN 'dead' ELSE 'nak' END AS outcome, ts + to_seconds(CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) AS due FROM d)
SELECT CAST(event_id AS VARCHAR) AS event_id, attempt, outcome, NULL AS no_outcome, due AS "at" FROM t UNION ALL SELECT CAST(event_id AS VARCHAR), attempt, 'dead', 'no outcome', due FROM t WHERE attempt = 3"""
)
def redelivery_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery of events whose first deliveries fail: waits between them, and dead letters before the last one."""
    events = read(spark, sf, "events").select(text(F.col("event_id")).alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("event_id") % 5).cast("int").alias("f"))
    return delivery.redelivered_batch(events, F.col("f"))


@registered(
    """WITH l AS (SELECT event_id, user_id % 8 AS p, 'r' || user_id AS r, event_id % 50 AS v, event_id // 8 + 1 AS seq FROM events), w AS (SELECT r, v, min(event_id) AS d FROM l WHERE event_id % 3 = 0 GROUP BY r, v),
c AS (SELECT p, max(seq) AS counter FROM l GROUP BY p), a AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 100000 ELSE 0 END + seq AS place FROM l WHERE event_id % 7 = 0)
SELECT DISTINCT 'content' AS trip, p::INT AS stream_partition, l.r AS id FROM l JOIN w ON w.r = l.r AND w.v = l.v AND l.event_id <> d WHERE event_id % 4 <> 1
UNION ALL SELECT DISTINCT 'position', a.p::INT, r FROM a JOIN c USING (p) WHERE place > counter
UNION ALL SELECT DISTINCT 'identity', a.p::INT, a.r FROM a JOIN c USING (p) JOIN l ON l.p = a.p AND l.seq = a.place WHERE place <= counter AND l.event_id <> a.event_id"""
)
def tripwires(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pulled inputs, projected rows, positions and an outbox of which every kind of rollback shows."""
    n = F.col("event_id")
    e = read(spark, sf, "events").select(n, (F.col("user_id") % 8).cast("int").alias("partition"), F.concat(F.lit("r"), text(F.col("user_id"))).alias("record_id"), (n % 50).alias("version"), F.expr("event_id div 8 + 1").alias("seq"), text(n).alias("digest"), F.lit("i1").alias("impl"))
    e = e.withColumn("epoch", F.lit("2.0"))
    rows = e.where("event_id % 3 = 0").groupBy("impl", "epoch", "record_id", "version").agg(F.min("event_id").alias("d")).select("impl", "epoch", "record_id", "version", F.lit("complete").alias("state"), text(F.col("d")).alias("digest"))
    pulled = e.withColumn("epoch", F.when(n % 4 == 1, "1.0").otherwise("2.0"))  # an older epoch shows nothing
    asked = e.where("event_id % 7 = 0").withColumn("seq", F.when(n % 11 == 0, F.col("seq") + 100_000).otherwise(F.col("seq")))
    counters = e.groupBy("partition", "impl", "epoch").agg(F.max("seq").alias("seq"))
    return projection.tripwires(pulled, rows, asked, counters, e)


ALIGN_SQL = """l AS (SELECT c_custkey AS id, c_custkey % 4 AS p, CASE WHEN c_custkey % 3 = 0 THEN 'tombstone' ELSE 'complete' END AS state, c_custkey % 10 AS version, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS g FROM customer),
s AS (SELECT o_custkey AS id, min(o_orderkey % 12) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey), echo AS (SELECT p, 100 + p AS p0 FROM range(3) t(p)),
r AS (SELECT l.id, CASE l.id % 5 WHEN 0 THEN 'purged' WHEN 1 THEN 'tombstone' ELSE 'exists' END AS a, l.id % 15 AS v, p0 FROM l LEFT JOIN echo ON echo.p = l.p WHERE g <> 2 AND l.id NOT IN (SELECT id FROM s)),
p AS (SELECT id, 'complete' AS ns, v AS nv FROM s UNION ALL SELECT id, CASE WHEN a = 'exists' THEN 'complete' ELSE 'tombstone' END, CASE WHEN a = 'purged' THEN p0 ELSE v END FROM r),
rows AS (SELECT 'row' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN k THEN ns ELSE state END AS state, CAST(CASE WHEN k THEN nv ELSE version END AS BIGINT) AS version FROM (SELECT *, nv IS NOT NULL AND (version IS NULL OR g <> 2 OR version < nv) AS k FROM l FULL JOIN p USING (id))),
q AS (SELECT event_id, user_id % 4 AS p, event_id % 250 AS seq, CASE event_id % 3 WHEN 0 THEN 'i2' ELSE 'i1' END AS impl, CASE event_id % 5 WHEN 0 THEN '1.0' ELSE '2.0' END AS epoch FROM events WHERE event_id % 10 < 7)"""


@registered(
    f"""WITH {ALIGN_SQL} SELECT * FROM rows UNION ALL SELECT 'position', CAST(p AS VARCHAR), NULL, p0 FROM echo
UNION ALL SELECT 'quarantine', CAST(event_id AS VARCHAR), NULL, seq FROM q LEFT JOIN echo USING (p) WHERE impl = 'i1' AND epoch = '2.0' AND (p0 IS NULL OR seq > p0)"""
)
def align_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """A projection fetched again: its rows, its positions and what stays in quarantine, all moved to the echoes of one pull."""
    k, n = F.col("c_custkey"), F.col("event_id")
    customer = read(spark, sf, "customer")
    name, part = text(k).alias("record_id"), (k % 4).cast("int").alias("partition")
    local = customer.select(name, part, F.when(k % 3 == 0, "tombstone").otherwise("complete").alias("state"), (k % 10).alias("version"), F.when(k % 4 == 0, 2).otherwise(1).alias("aligned_gen"))
    snapshot = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(text(F.col("o_custkey")).alias("record_id")).agg(F.min(F.col("o_orderkey") % 12).alias("version"))
    answers = customer.select(name, part, F.when(k % 5 == 0, "purged").when(k % 5 == 1, "tombstone").otherwise("exists").alias("state"), (k % 15).alias("version"))
    echoes = spark.range(3).select(F.col("id").cast("int").alias("partition"), (F.col("id") + 100).alias("p0"))
    held = read(spark, sf, "events").where(n % 10 < 7).select(
        F.lit("users").alias("projection"), text(n).alias("subject"), F.when(n % 3 == 0, "i2").otherwise("i1").alias("impl"), F.when(n % 5 == 0, "1.0").otherwise("2.0").alias("epoch"), (F.col("user_id") % 4).cast("int").alias("partition"), (n % 250).alias("seq"),
    )
    adopted = spark.createDataFrame([("users", "i1", "2.0")], "projection string, impl string, epoch string")
    rows, positions, kept = projection.align_watermark(local, snapshot, answers, 2, echoes, held, adopted)
    none = F.lit(None).cast("string").alias("state")
    out = rows.select(F.lit("row").alias("kind"), F.col("record_id").alias("id"), "state", "version")
    out = out.unionByName(positions.select(F.lit("position").alias("kind"), text(F.col("partition")).alias("id"), none, F.col("seq").alias("version")))
    return out.unionByName(kept.select(F.lit("quarantine").alias("kind"), F.col("subject").alias("id"), none, F.col("seq").alias("version")))
