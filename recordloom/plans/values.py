"""Queries of canonical values, amounts, names and positions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import canonical, decimals, keys
from recordloom.operators import folds
from recordloom.plans.queries import registered
from recordloom.sources.tables import read


@registered(
    """SELECT o_orderkey AS id, '{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","instant":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","key":"' || o_orderkey || '"'
 || CASE WHEN o_orderstatus <> 'P' THEN ',"paid":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END ELSE '' END || ',"raw":"' || to_base64(CAST(o_orderpriority AS BLOB)) || '"'
 || ',"tags":["' || o_orderstatus || '","' || o_orderpriority || '"],"total":"' || regexp_replace(regexp_replace(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '') || '"}' AS body FROM orders"""
)
def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    """One object of every archive type for each order; null members are left out."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    kinds = {
        "key": (F.col("o_orderkey"), "bigint"), "paid": (F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"), "boolean"), "total": ((cents.cast("decimal(20,0)") / 100).cast("decimal(38,18)"), "numeric"),
        "day": (F.to_date("o_orderdate"), "date"), "instant": (F.col("o_orderdate").cast("timestamp"), "timestamp"), "raw": (F.encode("o_orderpriority", "UTF-8"), "binary"), "tags": (F.array("o_orderstatus", "o_orderpriority"), "text[]"),
    }
    body = canonical.canonical_object({name: canonical.canonical(column, kind) for name, (column, kind) in kinds.items()})
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))


@registered(
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN repeat('9', 38) WHEN 1 THEN '-' || event_id || '.' || repeat('0', 5) WHEN 2 THEN '0' || event_id WHEN 3 THEN repeat('7', 21) || '.50' WHEN 4 THEN repeat('1', 39) ELSE '0.' || repeat('0', 36) || '1' END AS text FROM events)
SELECT event_id, CASE WHEN regexp_full_match(text, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') AND NOT regexp_full_match(text, '-0(\\.0+)?') AND length(replace(replace(text, '-', ''), '.', '')) <= 38
 THEN CASE WHEN contains(text, '.') THEN regexp_replace(regexp_replace(text, '0+$', ''), '\\.$', '') ELSE text END END AS amount FROM t"""
)
def money_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of up to 38 digits, wherever their point stands."""
    n, e = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = (
        F.when(n == 0, F.lit("9" * 38)).when(n == 1, F.concat(F.lit("-"), e, F.lit(".00000"))).when(n == 2, F.concat(F.lit("0"), e))
        .when(n == 3, F.lit("7" * 21 + ".50")).when(n == 4, F.lit("1" * 39)).otherwise(F.lit("0." + "0" * 36 + "1"))
    )
    return read(spark, sf, "events").select("event_id", decimals.parse_amount_text(text).alias("amount"))


@registered(
    """SELECT event_id, 'sha256:' || sha256('be.idempotency.request.v1' || chr(10) || '{"body_sha256":"' || sha256(props) || '","operation":"' || event_type || '","principal":"user-' || user_id || '","target":"POST /things/' || event_id || '"}') AS fingerprint FROM events"""
)
def request_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    principal, target = F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("POST /things/"), F.col("event_id").cast("string"))
    return e.select("event_id", canonical.request_fingerprint(principal, F.col("event_type"), target, F.col("props")).alias("fingerprint"))


@registered(
    """SELECT event_id, 'shop/' || event_type || '.x-sub_' || user_id = '' AS never, replace(replace('shop.' || event_type || '-s/' || user_id, '.', '_'), '/', '_') AS durable, 'shop.' || user_id % 4 || '.' || event_type AS subject,
 substr(props || props, 1, 12) AS short, strftime(ts, '%Y-%m') AS period, 'cold/u' || user_id || '/' || user_id % 3 || '.' || event_id % 5 || '/' || event_type || '.parquet' AS object,
 event_type <> 'error' AS valid, user_id % 4 = 2 AS second, event_type = 'purchase' AS purchase FROM events"""
)
def key_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of consumers, subjects, objects and periods, and patterns over subjects."""
    e = read(spark, sf, "events")
    subject = keys.subject(F.lit("shop"), F.pmod("user_id", F.lit(4)), F.col("event_type"))
    user = F.col("user_id").cast("string")
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("k "), user)).otherwise(F.concat(F.lit("k-"), user))
    return e.select(
        "event_id", F.lit(False).alias("never"), keys.durable_name(F.concat(F.lit("shop."), "event_type"), F.concat(F.lit("s/"), user)).alias("durable"), subject.alias("subject"),
        keys.title(F.concat("props", "props"), 12).alias("short"), keys.period(F.col("ts")).alias("period"),
        keys.object_key("cold", F.concat(F.lit("u"), user), F.col("user_id") % 3, F.col("event_id") % 5, F.col("event_type")).alias("object"),
        keys.valid_key(key).alias("valid"), subject.rlike(keys.subject_pattern("shop.2.>")).alias("second"), subject.rlike(keys.subject_pattern("shop.*.purchase")).alias("purchase"),
    )


@registered(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id || '.' || event_id % 7 WHEN 1 THEN user_id || '.' WHEN 2 THEN 'a.' || user_id ELSE '0' || user_id || '.' || event_id END AS text FROM events)
SELECT event_id, CASE WHEN ok THEN TRY_CAST(split_part(text, '.', 1) AS BIGINT) END AS generation, CASE WHEN ok THEN TRY_CAST(split_part(text, '.', 2) AS BIGINT) END AS timeline,
 coalesce(ok AND (TRY_CAST(split_part(text, '.', 1) AS BIGINT) > 10 OR (TRY_CAST(split_part(text, '.', 1) AS BIGINT) = 10 AND TRY_CAST(split_part(text, '.', 2) AS BIGINT) > 3)), false) AS newer
FROM (SELECT *, CASE WHEN regexp_full_match(text, '[0-9]{1,18}\\.[0-9]{1,18}') THEN true END AS ok FROM t)"""
)
def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs of texts, null if malformed, and whether they come after 10.3."""
    n, user, event = F.col("event_id") % 5, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = F.when(n == 0, F.concat(user, F.lit("."), (F.col("event_id") % 7).cast("string"))).when(n == 1, F.concat(user, F.lit("."))).when(n == 2, F.concat(F.lit("a."), user)).otherwise(F.concat(F.lit("0"), user, F.lit("."), event))
    rows = read(spark, sf, "events").select("event_id", keys.epoch_of(text).alias("epoch"))
    floor = F.struct(F.lit(10).cast("long").alias("generation"), F.lit(3).cast("long").alias("timeline"))
    return rows.select("event_id", "epoch.generation", "epoch.timeline", F.coalesce(F.col("epoch") > floor, F.lit(False)).alias("newer"))


@registered(
    """SELECT event_id, least(300.0, 1.0 * pow(2.0, CAST(least(event_id % 80 + 1 - 1, 60) AS DOUBLE))) AS backoff, least(300.0, greatest(1.0, CAST(value AS DOUBLE))) AS wait FROM events"""
)
def backoff_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Doubling waits of attempts, and waits as long as an item has waited."""
    attempt = F.col("event_id") % 80 + 1
    return read(spark, sf, "events").select("event_id", keys.backoff_seconds(attempt, 1.0, 300.0).alias("backoff"), keys.wait_seconds(F.col("value")).cast("double").alias("wait"))


@registered(
    """WITH m AS (SELECT user_id, max(ts) AS mark FROM events GROUP BY user_id) SELECT d AS days, (SELECT bool_and(mark >= (SELECT max(mark) FROM m) - to_days(d)) FROM m) AS fresh FROM (VALUES (0), (1), (7), (400)) AS t(d)"""
)
def marks_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every user's last event is at most so many days older than the last of all."""
    marks = read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return folds.fresh_within(marks, "mark", [0, 1, 7, 400])
