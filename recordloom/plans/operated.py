"""Queries of operators' commands, progress of runs, declarations, envelopes and snapshot tokens, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import keys
from recordloom.operators import commands, declarations, evidence, recovery
from recordloom.plans.queries import registered
from recordloom.sources.tables import read
from recordloom.streaming import outbox as boxes

NTZ = "timestamp_ntz"


def one_of(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def listed(options: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{n} % {len(options)} + 1]"


STATES = ["dead", "paused", "pending", "retry_wait", "done"]
WHY = ["backlog_exceeded", "business_hold", "outcome_unknown"]
ASKED = ["requeue", "resolve", "hold", "none"]


@registered(
    f"""WITH i AS (SELECT event_id AS id, {listed(STATES, 'event_id')} AS state, CASE WHEN event_id % 5 = 1 THEN {listed(WHY, 'event_id // 5')} END AS why, event_id % 4 AS attempts, event_id % 7 = 0 OR (event_id % 5 = 1 AND event_id // 5 % 3 = 2) AS unknown, event_id % 2 = 0 AS verified, {listed(ASKED, 'event_id // 15')} AS c, ts FROM events),
n AS (SELECT *, CASE WHEN c = 'requeue' AND ((state = 'dead' AND NOT unknown) OR (state = 'paused' AND (why <> 'outcome_unknown' OR verified))) THEN 'pending' WHEN c = 'resolve' AND state IN ('dead', 'paused') THEN 'resolved' WHEN c = 'hold' AND state IN ('pending', 'retry_wait') THEN 'paused' END AS new FROM i)
SELECT id, coalesce(new, state) AS state, CASE WHEN new = 'paused' THEN 'business_hold' WHEN new IS NULL THEN why END AS pause_reason, CASE WHEN new = 'pending' THEN 0 ELSE attempts END AS attempts, unknown AND new IS DISTINCT FROM 'pending' AS outcome_unknown,
 CASE WHEN new = 'resolved' THEN 'done by hand' END AS result, CASE WHEN new = 'pending' THEN TIMESTAMP '2024-03-01' ELSE ts END AS run_at, CASE WHEN new = 'resolved' THEN TIMESTAMP '2024-03-01' END AS finished_at, c <> 'none' AND new IS NULL AS refused FROM n"""
)
def work_operated(spark: SparkSession, sf: str) -> DataFrame:
    """Work items after operators requeued, resolved or held them, one for each event."""
    n = F.col("event_id")
    e = read(spark, sf, "events")
    fifth = F.expr("event_id div 5")
    items = e.select(
        n.alias("id"), one_of(STATES, n).alias("state"), F.when(n % 5 == 1, one_of(WHY, fifth)).alias("pause_reason"), (n % 4).alias("attempts"), ((n % 7 == 0) | ((n % 5 == 1) & (fifth % 3 == 2))).alias("outcome_unknown"),
        F.lit(None).cast("string").alias("result"), F.col("ts").cast(NTZ).alias("run_at"), F.lit(None).cast(NTZ).alias("finished_at"),
    )
    asked = e.select(n.alias("id"), one_of(ASKED, F.expr("event_id div 15")).alias("command"), (n % 2 == 0).alias("verified"), F.lit("done by hand").alias("reason")).where("command <> 'none'")
    return commands.operated(items, asked, F.lit("2024-03-01").cast(NTZ))


RUN_SQL = """l AS (SELECT user_id AS run, event_id AS place, CASE WHEN event_type = 'error' THEN 'checkpoint' WHEN event_type = 'view' THEN 'before_call' ELSE 'call' END AS kind, 'c' || event_id % 4 AS name,
 CASE WHEN event_type = 'error' THEN props WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'effective' END AS value FROM events)"""


@registered(
    f"""WITH {RUN_SQL}, s AS (SELECT run, count(*) AS segment, max_by(value, place) AS progress, max(place) AS since FROM l WHERE kind = 'checkpoint' GROUP BY run),
c AS (SELECT l.run, name, max_by(value, place) AS value FROM l LEFT JOIN s ON s.run = l.run WHERE kind = 'call' AND (since IS NULL OR place > since) GROUP BY l.run, name), m AS (SELECT run, string_agg(name || '=' || value, ',' ORDER BY name) AS calls FROM c GROUP BY run),
o AS (SELECT run, max_by(kind, place) = 'before_call' AS unknown FROM l WHERE kind = 'before_call' OR (kind = 'call' AND value <> 'unknown') GROUP BY run)
SELECT run, coalesce(segment, 0) AS segment, progress, coalesce(calls, '') AS calls, coalesce(unknown, false) AS outcome_unknown FROM (SELECT DISTINCT run FROM l) LEFT JOIN s USING (run) LEFT JOIN m USING (run) LEFT JOIN o USING (run)"""
)
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress, call results and open outcome of runs after their logs, one run for each user."""
    kind, n = F.col("event_type"), F.col("event_id")
    value = F.when(kind == "error", F.col("props")).when(n % 3 == 0, "unknown").otherwise("effective")
    log = read(spark, sf, "events").select(F.col("user_id").alias("run"), n.alias("at"), F.when(kind == "error", "checkpoint").when(kind == "view", "before_call").otherwise("call").alias("kind"), F.concat(F.lit("c"), (n % 4).cast("string")).alias("name"), value.alias("value"))
    calls = F.array_join(F.transform(F.map_entries("calls"), lambda c: F.concat(c["key"], F.lit("="), c["value"])), ",")
    return commands.run_progress(log).withColumn("calls", calls)


@registered(
    """WITH c AS (SELECT 'c' || c_custkey AS consumer, c_nationkey % 3 AS g, c_custkey % 2 AS t, c_custkey % 7 <> 0 AS known, c_custkey FROM customer), a AS (SELECT o_custkey, bool_and(o_orderkey % 9 <> 0) AS every FROM orders GROUP BY o_custkey)
SELECT consumer, CAST(CASE WHEN known AND NOT coalesce(every, true) THEN c_custkey % 5 ELSE g END AS INT) AS generation, CAST(CASE WHEN known AND NOT coalesce(every, true) THEN 1 ELSE t END AS INT) AS timeline FROM c LEFT JOIN a ON o_custkey = c_custkey"""
)
def consumers_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs recorded after a redelivery: consumers that a producer has not answered keep the old one."""
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("c"), k.cast("string")).alias("consumer")
    current = c.select(name, (F.col("c_nationkey") % 3).cast("int").alias("generation"), (k % 2).cast("int").alias("timeline"))
    recorded = c.where("c_custkey % 7 <> 0").select(name, (k % 5).cast("int").alias("generation"), F.lit(1).alias("timeline"))
    answers = read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consumer"), F.col("o_orderkey").alias("producer"), (F.col("o_orderkey") % 9 != 0).alias("answered"))
    return recovery.settled(recorded, current, answers)


@registered("SELECT user_id, CASE WHEN bool_or(event_id % 40 = 0) THEN 'unprovable' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'diff' ELSE 'pass' END AS outcome FROM events GROUP BY user_id")
def checks_concluded(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of a check for each user: one that could not run proves nothing, whatever it found."""
    runs = read(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.bool_or(F.col("event_id") % 40 == 0).alias("failed"))
    return runs.select("user_id", evidence.check_outcome(F.col("n"), F.col("failed")).alias("outcome"))


@registered(
    """WITH e AS (SELECT *, event_id % 6 AS k FROM events) SELECT event_id, CASE k WHEN 1 THEN '' ELSE 'e' || event_id END AS id, 'shop.' || event_type AS type, CASE k WHEN 2 THEN 0 ELSE event_id % 50 END AS version, CASE k WHEN 3 THEN 0 ELSE event_id END AS seq, (user_id % 8)::INT AS partition,
 CASE k WHEN 1 THEN 'no_id_or_type' WHEN 2 THEN 'ce-version' WHEN 3 THEN 'ce-seq' END AS problem FROM e"""
)
def envelopes_received(spark: SparkSession, sf: str) -> DataFrame:
    """Events from their headers: some lack an id, some have a number that is none."""
    n = F.col("event_id")
    k, text = n % 6, n.cast("string")
    sent = keys.headers({
        "id": F.when(k != 1, F.concat(F.lit("e"), text)), "type": F.concat(F.lit("shop."), "event_type"), "version": F.when(k == 2, "seven").otherwise((n % 50).cast("string")),
        "seq": F.when(k == 3, F.lit("99999999999999999999")).otherwise(text), "partition": (F.col("user_id") % 8).cast("string"),
    })
    told = read(spark, sf, "events").select(n, keys.received(sent).alias("r"))
    return told.select("event_id", "r.id", "r.type", "r.version", "r.seq", "r.partition", "r.problem")


@registered(
    """WITH a AS (SELECT event_id AS request, event_id % 7 AS k, 'r' || user_id AS after FROM events)
SELECT request, CASE WHEN k IN (0, 6) THEN after END AS after, CASE k WHEN 1 THEN 'token' WHEN 2 THEN 'other_stream' WHEN 3 THEN 'changed' WHEN 4 THEN 'changed' WHEN 5 THEN 'no_stream' END AS problem FROM a WHERE k <> 6
UNION ALL SELECT request, NULL, NULL FROM a WHERE k = 6"""
)
def snapshot_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Pages asked for by tokens: good ones, broken ones, and those of another stream, instance or epoch; and first pages."""
    n = F.col("event_id")
    k = n % 7
    token = boxes.snapshot_token(F.when(k == 5, "shop.gone").otherwise("shop.users"), F.concat(F.lit("r"), F.col("user_id").cast("string")), F.when(k == 3, "i1").otherwise("i2"), F.when(k == 4, "1.0").otherwise("2.0"))
    asked = read(spark, sf, "events").select(n.alias("request"), F.when(k == 2, "shop.orders").when(k == 6, "shop.users").alias("stream"), F.when(k == 1, F.concat(F.lit("!"), token)).when(k != 6, token).alias("token"))
    sources = spark.createDataFrame([("shop.users", "i2", "2.0"), ("shop.orders", "i1", "1.0")], "stream string, impl string, epoch string")
    return boxes.snapshot_asked(asked, sources).select("request", "after", "problem")


@registered(
    """WITH r AS (SELECT 'part' || p_partkey AS t, p_partkey AS k FROM part),
o AS (SELECT CASE WHEN k % 10 = 4 THEN 'Bad' || k ELSE t || '.view' END AS key, t, k FROM r WHERE k % 6 <> 5 UNION ALL SELECT t || '.view', t, k FROM r WHERE k % 15 = 7 AND k % 6 <> 5 AND k % 10 <> 4)
SELECT t || '.owner' AS subject, 'dimension_kind' AS problem FROM r WHERE k % 3 = 0 UNION ALL SELECT t || '.price', 'no_currency' FROM r WHERE k % 4 = 0 UNION ALL SELECT t || '.price', 'no_watermark' FROM r WHERE k % 5 = 0 AND k % 4 <> 0
UNION ALL SELECT t || '.cost', 'no_read_key' FROM r WHERE k % 7 = 0 UNION ALL SELECT t || '.cost', 'query_use' FROM r WHERE k % 8 = 0 UNION ALL SELECT t, 'view_operation' FROM r WHERE k % 6 = 5 OR k % 10 = 4
UNION ALL SELECT DISTINCT key, 'risk_class' FROM o WHERE k % 9 = 0 UNION ALL SELECT DISTINCT key, 'minimum_path' FROM o WHERE k % 17 = 0 UNION ALL SELECT DISTINCT key, 'strict_audit' FROM o WHERE k % 11 = 0 UNION ALL SELECT DISTINCT key, 'impersonation' FROM o WHERE k % 13 = 0
UNION ALL SELECT key, p FROM o, (VALUES ('not_a_key'), ('not_one_action')) v(p) WHERE key LIKE 'Bad%' UNION ALL SELECT key, 'declared_twice' FROM o GROUP BY key HAVING count(*) > 1"""
)
def declaration_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A resource with dimensions, fields and a view for each part, with problems of every kind among them."""
    k = F.col("p_partkey")
    part = read(spark, sf, "part").select(k, F.concat(F.lit("part"), k.cast("string")).alias("type"))
    none = F.lit(None).cast("string")
    resources = part.select("type", F.concat("type", F.lit(".view")).alias("view_operation"))
    owners = part.select("type", F.lit("owner").alias("name"), F.when(k % 3 == 0, "colour").otherwise("principal").alias("kind"), F.lit("owner_id").alias("column"), none.alias("currency_column"), none.alias("pushdown"), none.alias("watermark"))
    prices = part.select("type", F.lit("price").alias("name"), F.lit("amount").alias("kind"), F.lit("price").alias("column"), F.when(k % 4 != 0, "currency").alias("currency_column"), F.lit("local_projection").alias("pushdown"), F.when(k % 5 != 0, "w").alias("watermark"))
    fields = part.select("type", F.lit("cost").alias("name"), F.lit("restricted").alias("class"), F.when(k % 7 != 0, "key").alias("read_key"), F.array(F.when(k % 8 == 0, "guess").otherwise("filter")).alias("queryable"))
    key = F.when(k % 10 == 4, F.concat(F.lit("Bad"), k.cast("string"))).otherwise(F.concat("type", F.lit(".view")))
    one = part.where("p_partkey % 6 <> 5").select(
        key.alias("key"), F.col("type").alias("resource_type"), F.when(k % 11 == 0, "create").otherwise("read").alias("purpose"), F.when(k % 17 == 0, "short").otherwise("strict_barrier").alias("minimum_path"), F.when(k % 9 != 0, "low").alias("risk_class"), F.when(k % 13 == 0, F.array(F.lit("notification"))).alias("side_effects"),
        (k % 11 == 0).alias("strict_audit"), (k % 13 == 0).alias("impersonation"), F.lit(False).alias("tightening_only"), k,
    )
    operations = one.unionByName(one.where("p_partkey % 15 = 7 AND p_partkey % 10 <> 4")).drop("p_partkey")
    return declarations.problems(resources, owners.unionByName(prices), fields, operations)
