"""Queries of archive units on files: orders and their lines are sealed, copied, released, erased, destroyed and rerouted.

Each query that changes units does so in a store of its own in the shared folder; the first two read one that is built
once for a session and table folder.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans import archive, queries
from recordloom.plans.queries import HISTORY_RESOURCE, NOW, ORDERS, PRINCIPAL, cents, policy, registered
from recordloom.sources.archive import differences
from recordloom.sources.coldstore import ColdStore, Table, void_exports
from recordloom.sources.tables import checkpointed, read, shared_folder

TABLES = {
    "orders": Table({"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp", "o_orderpriority": "text", "cents": "bigint"}, ("o_orderkey",), "o_orderkey"),
    "lines": Table({"l_orderkey": "bigint", "l_linenumber": "bigint", "l_partkey": "bigint", "l_returnflag": "text", "quantity": "bigint"}, ("l_orderkey", "l_linenumber"), "l_orderkey"),
}
AT_TEXT = "2001-09-01 00:00:00"
FOLDERS: dict[tuple[str, str], str] = {}  # of a session's stores, by its application and table folder
STATE_SQL = "CASE WHEN year < '1997' THEN 'released' WHEN year < '1999' THEN 'published' ELSE 'sealed' END"

COLD_SQL = f"""members AS (SELECT o_orderkey AS root_id, o_orderpriority || '~' || strftime(o_orderdate, '%Y') AS unit, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '2000-08-31'),
units AS (SELECT unit, year, {STATE_SQL} AS state, count(*) AS members FROM members GROUP BY unit, year)"""


def digests_sql(name: str, flag: str = "l_returnflag") -> str:
    """CTEs ``<name>_sums`` (unit, name, rows, sha256) and ``<name>`` (unit, digest) of every unit; ``flag`` is what a line's flag is."""
    return f"""{name}_rows AS (SELECT unit, 'orders' AS name, '["' || o_orderkey || '"]' AS pk, '{{"cents":"' || CAST(round(o_totalprice * 100) AS BIGINT) || '","o_custkey":"' || o_custkey || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '"}}' AS row FROM orders JOIN members ON root_id = o_orderkey
  UNION ALL SELECT unit, 'lines', '["' || l_orderkey || '","' || l_linenumber || '"]', '{{"l_linenumber":"' || l_linenumber || '","l_orderkey":"' || l_orderkey || '","l_partkey":"' || l_partkey || '"' || coalesce(',"l_returnflag":"' || f || '"', '') || ',"quantity":"' || CAST(l_quantity AS BIGINT) || '"}}' FROM (SELECT *, {flag} AS f FROM lineitem JOIN members ON root_id = l_orderkey JOIN orders ON o_orderkey = l_orderkey)),
{name}_hex AS (SELECT unit, name, pk, lpad(printf('%X', octet_length(CAST(row AS BLOB))), 16, '0') || hex(CAST(row AS BLOB)) AS h FROM {name}_rows),
{name}_sums AS (SELECT unit, t.name, count(h) AS rows, sha256(coalesce(unhex(string_agg(h, '' ORDER BY pk, h)), ''::BLOB)) AS sha256 FROM units CROSS JOIN (VALUES ('orders'), ('lines')) AS t(name) LEFT JOIN {name}_hex x USING (unit, name) GROUP BY unit, t.name),
{name} AS (SELECT unit, 'sha256:' || sha256('record.unit.v1' || chr(10) || '{{"class":"orders","schema_version":"1","tables":[' || string_agg('{{"name":"' || name || '","rows":"' || rows || '","sha256":"' || sha256 || '"}}', ',' ORDER BY name) || ']}}') AS digest FROM {name}_sums GROUP BY unit)"""


def at() -> Column:
    return F.lit(AT_TEXT).cast("timestamp")


def online_rows(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority", cents("o_totalprice").alias("cents"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    return {"orders": orders, "lines": lines}


def due(spark: SparkSession, sf: str) -> DataFrame:
    """``unit, root_id, year`` of the orders that may be sealed: a unit for each priority and year."""
    found = archive.candidates(read(spark, sf, "orders"), spark.createDataFrame([], "root_id long"), ORDERS, F.lit("2001-08-31").cast("timestamp_ntz"))
    year = F.date_format("o_orderdate", "yyyy")
    return found.select(F.concat_ws("~", "o_orderpriority", year).alias("unit"), F.col("o_orderkey").alias("root_id"), year.alias("year"))


def archived(spark: SparkSession, sf: str, own: bool = True) -> ColdStore:
    """A store whose units before 1999 were transferred, and those before 1997 released."""
    name = (spark.sparkContext.applicationId, sf)
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}" if own else FOLDERS.get(name) or f"{shared_folder(spark)}/archive-{zlib.crc32('/'.join(name).encode()):08x}"
    store = ColdStore(spark, folder, "orders", TABLES, now=at())
    if not own:
        FOLDERS[name] = folder
    if store.catalog_version() >= 3:  # a transfer of this session did it
        return store
    members, online = due(spark, sf), online_rows(spark, sf)
    units = members.select("unit", "year").distinct()
    store.seal(members, online)
    store.transfer(units.where("year < '1999'"), online)
    store.release(units.where("year < '1997'"))
    return store


@registered(
    f"""WITH {COLD_SQL}, {digests_sql('d')} SELECT unit, CASE WHEN state = 'sealed' THEN 0 ELSE 1 END AS version, CASE WHEN state = 'sealed' THEN 'online' ELSE 'object' END AS route, state, max(CASE WHEN name = 'orders' THEN rows END) AS orders, max(CASE WHEN name = 'lines' THEN rows END) AS lines, digest,
 state <> 'sealed' AS intact FROM units JOIN d USING (unit) JOIN d_sums USING (unit) GROUP BY ALL"""
)
def archive_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Units after seal, transfer and release: what the log says, and whether their files are as it says."""
    store = archived(spark, sf, own=False)
    units = store.units()

    def rows(name: str) -> Column:
        return F.element_at(F.filter("sums", lambda s: s["name"] == name), 1)["rows"].alias(name)

    told = units.select("unit", "version", "route", "state", *[rows(name) for name in TABLES], "digest")
    return told.join(store.intact(units), "unit", "left").withColumn("intact", F.coalesce("ok", F.lit(False))).drop("ok")


@registered(queries.ORACLES["archive_history"])
def archive_history(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: one answer from online rows and from the files of cold units, whatever stage each unit is in."""
    store = archived(spark, sf, own=False)
    log, members = store.units(), store.members()
    units = log.select("unit", "route", F.col("catalog_version").alias("route_version"), "state")
    online = archive.released(online_rows(spark, sf)["orders"], "o_orderkey", members, units)
    since = "2000-01-01T00:00:00+00:00"
    names = ("o_orderkey", "o_orderdate", "o_custkey")
    segments = [
        policy.Segment("view", {"priority": policy.Atom("in", values=("1-URGENT", "2-HIGH")), "owner": queries.ALL}, names, since),
        policy.Segment("view", {"priority": policy.Atom("in", values=("2-HIGH",)), "owner": queries.ALL}, (*names, "cents"), since),
    ]
    plan = policy.compile_plan(HISTORY_RESOURCE, segments, "view", PRINCIPAL, NOW)
    cold = store.cold("orders").select("unit", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "cents")
    rows = archive.history(online, cold, ORDERS, members, units, store.catalog_version(), HISTORY_RESOURCE, plan)
    return rows.withColumn("masked", F.array_join(policy.MASKED, ",")).drop(policy.MASKED)


@registered(
    f"""WITH {COLD_SQL}, l AS (SELECT l_orderkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_orderkey AS root_id, unit, CASE WHEN unit IS NULL OR year >= '1999' THEN 'not_here' WHEN year = '1995' THEN 'destroyed' WHEN unit = '2-HIGH~1998' THEN 'unavailable' ELSE 'found' END AS outcome, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders LEFT JOIN members ON root_id = o_orderkey)
SELECT root_id, unit, outcome, CASE WHEN outcome = 'found' THEN cents END AS cents, CASE WHEN outcome = 'found' THEN coalesce(lines, 0) END AS lines, CASE WHEN outcome = 'found' THEN quantity END AS quantity FROM t LEFT JOIN l ON l_orderkey = root_id"""
)
def archive_get(spark: SparkSession, sf: str) -> DataFrame:
    """Every order asked for by key: its aggregate from the unit's files, or why there is none."""
    store = archived(spark, sf)
    store.destroy(lambda: store.units().select("unit", F.when(F.col("unit").endswith("~1995"), F.array().cast("array<string>")).otherwise(F.array(F.lit("not_due"))).alias("reasons")), "retention").count()
    store._delete(store.objects().where("unit = '2-HIGH~1998'").orderBy("path").limit(1))  # a file is lost
    units = store.units()
    good = units.join(store.intact(units.where(F.col("state").isin("published", "released"))).where("ok"), "unit", "left_semi")
    lines = store.rows("lines", good).groupBy(F.col("l_orderkey").alias("root_id")).agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))
    found = store.rows("orders", good).select(F.col("o_orderkey").alias("root_id"), "cents").join(lines, "root_id", "left").select("root_id", F.struct("cents", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), "quantity").alias("a"))
    told = read(spark, sf, "orders").select(F.col("o_orderkey").alias("root_id")).join(store.members(), "root_id", "left").join(units.select("unit", "state"), "unit", "left").join(found, "root_id", "left")
    outcome = F.when(F.col("state") == "destroyed", "destroyed").when(F.col("state").isNull() | (F.col("state") == "sealed"), "not_here").when(F.col("a").isNotNull(), "found").otherwise("unavailable")
    return told.select("root_id", "unit", outcome.alias("outcome"), "a.cents", "a.lines", "a.quantity")


@registered(
    f"""WITH {COLD_SQL}, {digests_sql('before')}, {digests_sql('later', "CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE l_returnflag END")}
SELECT o_orderkey AS root_id, m.unit, CASE WHEN m.unit IS NULL THEN 'online' WHEN m.unit LIKE '1-URGENT%' THEN 'deferred' ELSE 'erased' END AS outcome, b.digest AS old, CASE WHEN m.unit NOT LIKE '1-URGENT%' THEN l.digest END AS new
FROM orders LEFT JOIN members m ON root_id = o_orderkey LEFT JOIN before b ON b.unit = m.unit LEFT JOIN later l ON l.unit = m.unit WHERE o_custkey % 10 = 3"""
)
def archive_erase(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of some customers' lines erased: each unit's digest before and after, sealed or on files; held units wait."""
    store = archived(spark, sf)
    held = store.units().where("unit LIKE '1-URGENT%'")
    ids = read(spark, sf, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("root_id"))
    return store.erase(ids, ("l_returnflag",), online_rows(spark, sf), held)


@registered(
    f"""WITH {COLD_SQL} SELECT unit, CASE WHEN year >= '1998' THEN 'not_due' WHEN unit LIKE '5-LOW%' AND members % 2 = 0 THEN 'approval,held' WHEN unit LIKE '5-LOW%' THEN 'held' WHEN members % 2 = 0 THEN 'approval' ELSE '' END AS reasons,
 CASE WHEN year >= '1998' OR unit LIKE '5-LOW%' OR members % 2 = 0 THEN state ELSE 'destroyed' END AS state, CASE WHEN year >= '1999' OR NOT (year >= '1998' OR unit LIKE '5-LOW%' OR members % 2 = 0) THEN 0 ELSE 2 END AS files,
 CASE WHEN NOT (year >= '1998' OR unit LIKE '5-LOW%' OR members % 2 = 0) THEN 'effective,intent' ELSE '' END AS evidence,
 CASE WHEN NOT (year >= '1998' OR unit LIKE '5-LOW%' OR members % 2 = 0) THEN 'unit ' || unit || ' retention' END AS tombstone FROM units"""
)
def archive_destroy(spark: SparkSession, sf: str) -> DataFrame:
    """Units whose retention ended are destroyed unless held or not approved; what is left of each, and the evidence."""
    store = archived(spark, sf)
    sizes = store.members().groupBy("unit").agg(F.count("*").alias("members"))

    def reasons() -> DataFrame:
        year = F.split_part("unit", F.lit("~"), F.lit(2))
        why = F.array_compact(F.array(F.when(F.col("members") % 2 == 0, "approval"), F.when(F.col("unit").startswith("5-LOW"), "held")))
        return sizes.select("unit", F.when(year >= "1998", F.array(F.lit("not_due"))).otherwise(why).alias("reasons"))

    told = store.destroy(reasons, "retention")
    files = store.objects().groupBy("unit").agg(F.count("*").alias("files"))
    phases = store.evidence().groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("evidence"))
    note = F.from_json("note", "scope string, unit string, basis string")
    stones = store.units().select("unit", F.concat_ws(" ", note["scope"], note["unit"], note["basis"]).alias("tombstone")).where("tombstone <> ''")
    out = told.join(files, "unit", "left").join(phases, "unit", "left").join(stones, "unit", "left")
    return out.select("unit", F.array_join("reasons", ",").alias("reasons"), "state", F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("evidence", F.lit("")).alias("evidence"), "tombstone")


@registered(
    f"""WITH {COLD_SQL}, s AS (SELECT unnest(['before', 'during', 'after']) AS stage), o AS (SELECT unit, state, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM members JOIN orders ON o_orderkey = root_id JOIN units USING (unit) WHERE state <> 'sealed' GROUP BY unit, state)
SELECT stage, unit, CASE WHEN stage = 'after' AND state = 'published' THEN 'warm' ELSE 'object' END AS route, CASE WHEN stage = 'after' AND state = 'published' THEN 2 ELSE 1 END AS version, orders, cents FROM o, s"""
)
def archive_reroute(spark: SparkSession, sf: str) -> DataFrame:
    """Published units moved to another route; each unit as three snapshots see it: before, while the copy was written, after."""
    store = archived(spark, sf)
    first = store.catalog_version()
    store.written({name: store.cold(name) for name in TABLES})  # a copy that no log row names yet
    during = store.catalog_version()
    last = store.reroute(store.units().where("state = 'published'"), "warm")
    found = None
    for stage, version in (("before", first), ("during", during), ("after", last)):
        sums = store.cold("orders", version).groupBy("unit").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))
        one = store.units(version).select("unit", "route", "version").join(sums, "unit").select(F.lit(stage).alias("stage"), "unit", "route", "version", "orders", "cents")
        found = one if found is None else found.unionByName(one)
    return found


@registered(
    f"""WITH {COLD_SQL}, r AS (SELECT unnest(['grace', 'lease', 'no_backup', 'none']) AS asked) SELECT asked, unit, CASE WHEN asked = 'none' THEN '' ELSE asked END AS reasons, asked <> 'none' AS kept FROM units, r WHERE state = 'published'"""
)
def archive_old_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Copies that a reroute replaced stay for each single reason, and go without one."""
    store = archived(spark, sf)
    before = store.catalog_version()
    store.reroute(store.units().where("state = 'published'"), "warm")
    current = store.units().select("unit", "copy")
    later = at() + F.make_dt_interval(F.lit(1))

    def lease(version: int) -> DataFrame:
        return spark.createDataFrame([(version,)], "catalog_version int").withColumn("expires_at", later + F.make_dt_interval(F.lit(1)))

    asked = {"grace": (10**6, store.catalog_version(), later), "lease": (60, before, later), "no_backup": (60, store.catalog_version(), at()), "none": (60, store.catalog_version(), later)}
    found = None
    for name, (grace, version, backup) in asked.items():
        told = store.release_old(later, grace, lease(version), backup)
        left = store.objects().join(current, ["unit", "copy"], "left_anti").select("unit").distinct().withColumn("kept", F.lit(True))
        one = checkpointed(told.join(left, "unit", "left").select(F.lit(name).alias("asked"), "unit", F.array_join("reasons", ",").alias("reasons"), F.coalesce("kept", F.lit(False)).alias("kept")))
        found = one if found is None else found.unionByName(one)
    return found


@registered(
    f"""WITH {COLD_SQL}, c AS (SELECT * FROM units WHERE state <> 'sealed') SELECT 'missing_object' AS kind, '2-HIGH~1998' AS unit, count(*) AS n FROM c WHERE unit = '2-HIGH~1998'
UNION ALL SELECT 'other_size', '1-URGENT~1996', count(*) FROM c WHERE unit = '1-URGENT~1996' UNION ALL SELECT 'stray_object', unit, 2 FROM c WHERE unit NOT IN ('2-HIGH~1998', '1-URGENT~1996') UNION ALL SELECT 'warm_rows', unit, 1 FROM units WHERE state = 'sealed' AND members % 3 = 0"""
)
def archive_check(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog against real files and warm rows: a lost file, one of another size, a copy that was never published, short rows."""
    store = archived(spark, sf)
    lost = store.objects().where("unit = '2-HIGH~1998'").orderBy("path").first().path
    store._files().delete(store._path("data", lost), False)
    other = store.objects().where("unit = '1-URGENT~1996'").orderBy("path").first().path
    stream = store._files().create(store._path("data", other), True)
    stream.write(0)
    stream.close()
    units = store.units()
    store.written({name: store.rows(name, units.where("unit <> '2-HIGH~1998' AND unit <> '1-URGENT~1996'")) for name in TABLES})
    return checked(store, units)


def checked(store: ColdStore, units: DataFrame) -> DataFrame:
    """``kind, unit, n``: the differences of a store's files from its log, and of warm rows that lack one in three units."""
    objects = units.where("files IS NOT NULL").select("unit", "route", "version", F.explode("files").alias("f")).select("unit", "route", "version", F.lit(None).cast("long").alias("rows"), "f.path", "f.size")
    warm = units.where("state = 'sealed'").select("unit", F.lit("warm").alias("route"), "version", F.element_at(F.filter("sums", lambda s: s["name"] == "orders"), 1)["rows"].alias("rows"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"))
    listing = store.objects().select("path", "size")
    short = F.when(F.col("rows") % 3 == 0, F.col("rows") - 1).otherwise(F.col("rows"))
    found = differences(objects.unionByName(warm), listing, warm.select("unit", "version", short.alias("rows")))
    unit = F.when(F.col("kind") == "warm_rows", F.col("id")).otherwise(F.regexp_extract("id", "/unit=([^/]+)/", 1))
    return found.select("kind", unit.alias("unit")).groupBy("kind", "unit").agg(F.count("*").alias("n"))


@registered(
    """SELECT o_orderkey AS export, o_orderstatus = 'O' AND o_custkey % 2 = 0 AS marked, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_orderdate > TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01' ELSE o_orderdate END AS expires_at FROM orders"""
)
def exports_voided(spark: SparkSession, sf: str) -> DataFrame:
    """Exports of a class after an erasure in it: finished ones expire, pending ones are marked."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    now: Column = F.lit("1998-01-01").cast("timestamp_ntz")
    exports = read(spark, sf, "orders").select(F.col("o_orderkey").alias("export"), F.when(F.col("o_custkey") % 2 == 0, "orders").otherwise("invoices").alias("class"), state.alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("erased_at"))
    return void_exports(exports, "orders", now).select("export", F.col("erased_at").isNotNull().alias("marked"), "expires_at")
