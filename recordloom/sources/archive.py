"""Archive files: units of aggregates as Parquet under versioned paths, named by manifests.

A unit's tables are directories ``unit=<u>/version=<v>/table=<t>``; a manifest row makes a version readable, so a
copy that failed half-way is never seen. Rows of all units of one transfer are written in one job, partitioned by
unit; ``maxRecordsPerFile`` bounds the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.sources.tables import assert_schema

ROWS_PER_FILE = 200_000
CLAIM_BYTES = 64 * 1024


def write_table(rows: DataFrame, folder: str, version: int, name: str) -> str:
    """Write one table's rows (with a column ``unit``) of a version; columns in name order; returns the path."""
    path = f"{folder.rstrip('/')}/version={version}/table={name}"
    ordered = rows.select("unit", *sorted(c for c in rows.columns if c != "unit"))
    ordered.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("unit").mode("errorifexists").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, declared: StructType, units: list[str] | None = None) -> DataFrame:
    """Rows of a written table, with ``unit``; only the asked units' directories are read."""
    columns = StructType(sorted(declared.fields, key=lambda f: f.name))
    found = spark.read.option("basePath", path).parquet(path)
    if units is not None:
        found = found.where(F.col("unit").isin(*units))
    assert_schema(found.drop("unit"), columns)
    return found.withColumn("unit", F.col("unit").cast("string"))


def write_warm(rows: DataFrame, folder: str) -> None:
    """Replace the warm rows (unit, version, table, pk, row) of the written (unit, version, table) and of no others."""
    ordered = rows.select("pk", "row", "unit", "version", "table")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit", "version", "table").parquet(folder)


def operations(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``id, kind, received, body, valid`` of the operations log's records of a kind: JSON files, one record a line, whose
    signatures were checked when they came (``valid``)."""
    schema = "id string, kind string, received timestamp, body string, valid boolean"
    return spark.read.schema(schema).json(folder).where((F.col("kind") == kind) & F.col("valid"))


def next_generation(units: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row ``generation``: one more than the largest known to the catalog or the operations log; 1 at first."""
    both = units.select(F.col("generation").cast("long")).unionByName(recorded.select(F.col("generation").cast("long")))
    return both.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def verified(spark: SparkSession, paths: list[str], expected: DataFrame) -> DataFrame:
    """``path, ok`` of object files against ``expected`` (path, sha256, size)."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.length("content").cast("long").alias("found_size"), F.sha2("content", 256).alias("found"))
    joined = expected.join(files, "path", "left")
    return joined.select("path", F.coalesce((F.col("found") == F.col("sha256")) & (F.col("found_size") == F.col("size")), F.lit(False)).alias("ok"))


def manifest(sums: DataFrame, version: int) -> DataFrame:
    """``unit, version, tables, manifest``: one canonical JSON row per unit from its tables' sums (unit, name, rows, sha256)."""
    tables = F.array_sort(F.collect_list(F.struct("name", F.col("rows").cast("string").alias("rows"), "sha256")))
    body = sums.groupBy("unit").agg(tables.alias("tables")).withColumn("version", F.lit(version))
    return body.withColumn("manifest", F.to_json(F.struct("tables", "unit", "version")))


def export_lines(rows: DataFrame) -> DataFrame:
    """``value``: a JSON object per row, names in order, masked (null) fields kept as null."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_export(rows: DataFrame, path: str) -> int:
    """Write lines of JSON and tell how many."""
    lines = export_lines(rows)
    lines.write.mode("errorifexists").text(path)
    return lines.sparkSession.read.text(path).count()


def claim_checked(events: DataFrame, prefix: str, limit: int = CLAIM_BYTES) -> DataFrame:
    """``events`` with ``claim`` (uri, size, sha256) in place of payloads above ``limit`` bytes."""
    large = F.length("payload") > limit
    claim = F.struct(F.concat(F.lit(prefix.rstrip("/") + "/"), "event_id").alias("uri"), F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha256"))
    return events.withColumn("claim", F.when(large, claim)).withColumn("payload", F.when(~large, F.col("payload")))


def resolved(events: DataFrame, store: DataFrame) -> DataFrame:
    """``events`` with claimed payloads from ``store`` (uri, content); ``claim_ok`` is false where size or digest differ."""
    joined = events.join(store.select("uri", "content"), events["claim.uri"] == F.col("uri"), "left")
    ok = (F.length("content") == F.col("claim.size")) & (F.sha2("content", 256) == F.col("claim.sha256"))
    out = joined.withColumn("claim_ok", F.when(F.col("claim").isNotNull(), F.coalesce(ok, F.lit(False))))
    return out.withColumn("payload", F.when(F.col("claim_ok"), F.col("content")).otherwise(F.col("payload"))).drop("uri", "content")


def differences(catalog: DataFrame, listing: DataFrame, warm: DataFrame) -> DataFrame:
    """``kind, id, detail``: what catalog, object listing and warm rows disagree on.

    ``catalog``: unit, route, version, rows, path, size; ``listing``: path, size; ``warm``: unit, version, rows.
    """
    objects = catalog.where("route = 'object'")
    told = objects.join(listing.select("path", F.col("size").alias("found")), "path", "left")
    missing = told.where("found IS NULL").select(F.lit("missing_object").alias("kind"), F.col("path").alias("id"), F.col("unit").alias("detail"))
    other = told.where("found <> size").select(F.lit("other_size").alias("kind"), F.col("path").alias("id"), F.concat_ws("/", F.col("found").cast("string"), F.col("size").cast("string")).alias("detail"))
    stray = listing.join(objects.select("path"), "path", "left_anti").select(F.lit("stray_object").alias("kind"), F.col("path").alias("id"), F.lit("").alias("detail"))
    rows = catalog.where("route = 'warm'").join(warm.select("unit", "version", F.col("rows").alias("found")), ["unit", "version"], "left")
    short = rows.where(F.coalesce("found", F.lit(0)) != F.col("rows")).select(
        F.lit("warm_rows").alias("kind"), F.col("unit").alias("id"), F.concat_ws("/", F.coalesce("found", F.lit(0)).cast("string"), F.col("rows").cast("string")).alias("detail")
    )
    return missing.unionByName(other).unionByName(stray).unionByName(short)


def orphan_rows(rows: DataFrame, manifests: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows of versions that no manifest names, unless they may belong to a transfer that still runs."""
    return rows.where(F.col("written_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours))).join(manifests.select("unit", "version"), ["unit", "version"], "left_anti")
