"""Queries of canonical JSON and of the records that rest on it, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import records
from recordloom.functions.canonical import canonical_set, canonical_text
from recordloom.plans.queries import registered
from recordloom.sources.tables import read

# JSON of every shape the encoding takes or refuses, from the columns of an event; Spark and DuckDB build the same texts.
SHAPES = {
    0: ("""concat('{"b": ', props, ', "a": [1, {"z": "', event_type, '", "y": [true, false]}], "A": "', user_id, '"}')""", """concat('{"A":"', user_id, '","a":[1,{"y":[true,false],"z":"', event_type, '"}],"b":{"k":', props_k, '}}')""", None),
    1: ("""concat('{"n": null, "o": {"m": ', event_id, ', "x": null}}')""", """concat('{"o":{"m":', event_id, '}}')""", None),
    2: ("""concat('[', event_id, '.5]')""", None, "fraction"),
    3: ("""concat('{"id": 900719925474099', event_id % 3 + 1, '}')""", """concat('{"id":900719925474099', event_id % 3 + 1, '}')""", None),
    4: ("""concat('{"k": ', event_id, ', "k": ', user_id, '}')""", None, "duplicate_name"),
    5: ("""concat('"', chr(92), 'u00', CASE WHEN user_id % 2 = 0 THEN '1F' ELSE '0b' END, chr(92), '/', chr(92), 'u0041', event_type, '" ')""", """concat('"', chr(92), 'u00', CASE WHEN user_id % 2 = 0 THEN '1f' ELSE '0b' END, '/A', event_type, '"')""", None),
    6: ("""concat('{"open": [', event_id)""", None, "not_json"),
    7: ("""concat('{"big": 900719925474099', event_id % 2 + 2, '}')""", None, "wide_integer"),
    8: ("""concat('[null, ', event_id, ']')""", None, "null"),
}


def shaped(column: int) -> str:
    cases = " ".join(f"WHEN {n} THEN {shape[column] or 'NULL'}" for n, shape in SHAPES.items())
    return f"CASE event_id % {len(SHAPES)} {cases} END"


REFUSED = f"CASE event_id % {len(SHAPES)} " + " ".join(f"WHEN {n} THEN {f"'{why}'" if why else 'NULL'}" for n, (_, _, why) in SHAPES.items()) + " END"
EVENTS = "(SELECT *, json_extract_string(props, '$.k') AS props_k FROM events)"


@registered(
    f"SELECT event_id, {shaped(1)} AS body, {REFUSED} AS refusal, coalesce({shaped(0)} = {shaped(1)}, false) AS already FROM {EVENTS}"
)
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON made of each event, its canonical form without null members or why it has none, and whether it was canonical."""
    told = read(spark, sf, "events").select("event_id", F.expr(shaped(0)).alias("text"))
    return told.withColumn("c", records.canonical_json(F.col("text"), drop_nulls=True)).select("event_id", "c.body", "c.refusal", records.is_canonical(F.col("text")).alias("already"))


@registered(
    f"""SELECT event_id, CASE WHEN event_id % 9 IN (0, 3) THEN 'sha256:' || sha256('be.security.' || event_type || '.v1' || chr(10) || {shaped(1)}) END AS digest,
 CASE WHEN event_id % 9 = 1 THEN 'null' WHEN event_id % 9 = 5 THEN 'not_an_object' ELSE {REFUSED} END AS refusal FROM {EVENTS}"""
)
def candidate_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of change requests' candidates: nulls are refused here."""
    told = read(spark, sf, "events").select("event_id", "event_type", F.expr(shaped(0)).alias("text"))
    return told.withColumn("c", records.candidate_digest(F.col("event_type"), F.col("text"))).select("event_id", "c.digest", "c.refusal")


DEFINITIONS_SQL = """d AS (SELECT 'shop/' || lower(replace(p_brand, '#', '-')) AS component, 'part-' || p_partkey AS key, * FROM part),
r AS (SELECT component, key, sha256('be.security.definition' || chr(10) || component || chr(10) || 'resource' || chr(10) || key) AS h,
  replace(replace(component, '/', '.'), '-', '_') || '.definition' AS domain,
  '{"owner":{"column":"owner_id","kind":"principal","pushdown":"local_column"}' || CASE WHEN p_size > 20 THEN ',"size":{"column":"size","kind":"value_set","pushdown":"local_column"}' ELSE '' END || '}' AS dims,
  '{"name":{"class":"ordinary","queryable":["' || array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '","') || '"]},"price":{"class":"restricted"}}' AS fields, p_type FROM d),
i AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM r),
w AS (SELECT component, key, '{"authority":"' || component || '","deployment":"test","dimensions":' || dims || ',"fields":' || fields || ',"id":"' || id || '","record_type":"be.security.resource_definition","revision":{"domain":"' || domain || '","value":"1.2.3"},"schema":"1.0","type":"' || key || '","view_operation":"' || lower(p_type) || '.view"}' AS raw FROM i),
defs AS (SELECT component, key, raw, 'sha256:' || sha256('be.security.resource_definition.v1' || chr(10) || raw) AS digest FROM w)"""


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    """A resource definition for each part: fields, dimensions and their sets."""
    t = canonical_text
    part = read(spark, sf, "part").withColumn("component", F.concat(F.lit("shop/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))).withColumn("key", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))

    def dimension(column: str, kind: str):
        return records.raw_object({"column": t(F.lit(column)), "kind": t(F.lit(kind)), "pushdown": t(F.lit("local_column"))})

    dims = records.raw_object({"owner": dimension("owner_id", "principal"), "size": F.when(F.col("p_size") > 20, dimension("size", "value_set"))})
    name = records.raw_object({"class": t(F.lit("ordinary")), "queryable": canonical_set(F.split("p_name", " "))})
    fields = records.raw_object({"name": name, "price": records.raw_object({"class": t(F.lit("restricted"))})})
    members = {"dimensions": dims, "fields": fields, "type": t(F.col("key")), "view_operation": t(F.concat(F.lower("p_type"), F.lit(".view")))}
    told = part.select("component", "key", F.create_map(*[x for n, c in members.items() for x in (F.lit(n), c)]).alias("members"))
    return records.definition_records(told, "be.security.resource_definition", "resource", "test", "1.2.3")


@registered(f"WITH {DEFINITIONS_SQL} SELECT key, raw, digest FROM defs")
def definition_records(spark: SparkSession, sf: str) -> DataFrame:
    return definitions(spark, sf).select("key", "raw", "digest")


@registered(
    f"""WITH {DEFINITIONS_SQL}, s AS (SELECT component, count(DISTINCT digest)::INT AS definitions, '["' || array_to_string(list_sort(list(DISTINCT digest)), '","') || '"]' AS l FROM defs GROUP BY component)
SELECT component, definitions, 'sha256:' || sha256('be.security.definition_set.v1' || chr(10) || '{{"component":"' || component || '","definitions":' || l || ',"version":"1.2.3"}}') AS digest FROM s"""
)
def definition_sets(spark: SparkSession, sf: str) -> DataFrame:
    return records.definition_sets(definitions(spark, sf), "1.2.3")


@registered(
    f"""WITH {DEFINITIONS_SQL}, k AS (SELECT *, CAST(substr(key, 6) AS BIGINT) % 4 AS n FROM defs)
SELECT key, CASE n WHEN 1 THEN 'not_canonical' WHEN 2 THEN 'digest' WHEN 3 THEN 'feature' END AS problem FROM k"""
)
def views_opened(spark: SparkSession, sf: str) -> DataFrame:
    """Received records: as sealed, with a space, with another digest, and with a feature that no reader knows."""
    n = F.substring("key", 6, 20).cast("long") % 4
    told = definitions(spark, sf).withColumn("n", n).withColumn("raw", F.when(F.col("n") == 1, F.concat("raw", F.lit(" "))).when(F.col("n") == 3, F.replace("raw", F.lit(',"revision"'), F.lit(',"required_features":["x"],"revision"'))).otherwise(F.col("raw")))
    digest = F.when(F.col("n") == 2, F.lit("sha256:00")).when(F.col("n") == 3, records.domain_digest("be.security.resource_definition", 1, F.col("raw"))).otherwise(F.col("digest"))
    return records.opened(told.withColumn("digest", digest), "be.security.resource_definition").select("key", "problem")


AUDITS_SQL = """a AS (SELECT event_id, '{"category":"business","changes":{"after":{"version":' || event_id % 1000 || '},"value":"' || user_id || '"},"id":"a' || event_id || '","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","operation":"shop.'
 || event_type || '","outcome":"success"' || CASE WHEN event_type = 'error' THEN ',"reason":"said ' || chr(92) || '"no' || chr(92) || '""' ELSE '' END || ',"target":{"id":"' || user_id || '","type":"user"}}' AS raw FROM events WHERE event_id % 7 <> 6)"""


@registered(
    f"""WITH {AUDITS_SQL} SELECT event_id, raw, CASE WHEN raw IS NOT NULL THEN 'sha256:' || sha256('be.audit.record.v1' || chr(10) || raw) END AS digest, CASE WHEN event_id % 7 = 6 THEN 'fraction' END AS refusal, event_id % 1000 AS version
FROM events LEFT JOIN a USING (event_id)"""
)
def audit_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records of events: absent parts are left out, nulls within them too, fractions are refused."""
    e, n = read(spark, sf, "events"), F.col("event_id")
    after = F.concat(F.lit('{"version": '), (n % 1000).cast("string"), F.lit(', "parent": null}'))
    value = F.when(n % 7 == 6, F.lit("1.5")).otherwise(F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
    rows = e.select(
        n, F.concat(F.lit("a"), n.cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"), F.lit("business").alias("category"), F.concat(F.lit("shop."), "event_type").alias("operation"), F.lit("success").alias("outcome"),
        F.when(F.col("event_type") == "error", 'said "no"').otherwise("").alias("reason"), F.lit(None).cast("string").alias("actor"), F.lit("").alias("represented"), F.concat(F.lit('{"type": "user", "id": "'), F.col("user_id").cast("string"), F.lit('"}')).alias("target"),
        F.concat(F.lit('{"value": '), value, F.lit(', "after": '), after, F.lit("}")).alias("changes"), F.lit(None).cast("string").alias("request"), after.alias("after"),
    )
    return records.audit_records(rows).select("event_id", "raw", "digest", "refusal", records.object_version(F.col("after")).alias("version"))


@registered(
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' OR (o_orderkey % 4 = 0) THEN 'released' ELSE 'refused' END AS outcome FROM orders"
)
def audit_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Strict reads are released with one receipt only: others lack it, have another status, or have two."""
    key = F.col("o_orderkey")
    orders = read(spark, sf, "orders")
    reads = orders.select(key.alias("id"), F.lit("view").alias("operation"), (F.col("o_orderstatus") == "F").alias("strict"))
    status = F.when(key % 4 == 1, "conflict").otherwise("received")
    told = orders.where(key % 4 != 3).select(key.alias("id"), F.explode(F.array_repeat(status, F.when(key % 4 == 2, 2).otherwise(1))).alias("status"))
    return records.receipts_judged(reads, told)


@registered(
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_a_record' WHEN 3 THEN 'other_component' WHEN 4 THEN 'phase' WHEN 5 THEN 'time' END AS problem,
 CASE WHEN event_id % 6 = 0 THEN 'user' END AS object_type, CASE WHEN event_id % 6 = 0 THEN CAST(user_id AS VARCHAR) END AS object_id, CASE WHEN event_id % 6 = 0 THEN ['effective', 'general', 'intent'][event_id % 3 + 1] END AS phase, CASE WHEN event_id % 6 = 0 THEN date_trunc('second', ts) END AS at FROM events"""
)
def evidence_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Records that a recovery may replay, one for each event, with every reason to refuse one."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    phase = F.when(n % 6 == 4, "cancelled").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("effective", "general", "intent")]), (n % 3 + 1).cast("int")))
    kind = F.when(n % 6 == 2, "be.other").otherwise(records.EVIDENCE)
    at = F.when(n % 6 == 5, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    whole = F.concat(
        F.lit('{"record_type":"'), kind, F.lit('","id":"e'), n.cast("string"), F.lit('","recorder":{"component":"'), F.when(n % 6 == 3, "other").otherwise("shop"), F.lit('"},"category":"c","phase":"'), phase,
        F.lit('","subject":"s","object":{"type":"user","id":"'), user, F.lit('"},"change":{},"at":"'), at, F.lit('"}'),
    )
    rows = read(spark, sf, "events").select("event_id", F.when(n % 6 == 1, F.substring(whole, 1, 20)).otherwise(whole).alias("raw"))
    told = records.replayed(rows, "shop")
    return told.select("event_id", "problem", "object_type", "object_id", "phase", F.col("at").cast("timestamp_ntz").alias("at"))
