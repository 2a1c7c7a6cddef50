"""Archive units as files in a shared folder, made visible by an append-only log.

A unit's rows are Parquet below ``data/table=<t>/copy=<c>/unit=<u>``; every job writes a new copy and never changes an old
one. The log, ``log/catalog_version=<n>``, holds a row for each unit that a job changed: version, route, state, digest of
the rows, and size and SHA-256 of every file. A job publishes by renaming its log rows to the next catalog version, which
fails if another job was there first, so a copy that ends half-way is never seen and a stale job publishes nothing. A
reader names a catalog version and sees, for each unit, the newest log row up to it.

The rename is atomic where the file system's is (HDFS, a local disk); a store without atomic renames needs one job at a time.
Folders of units are pruned by unit where few are asked for, and by a join on the log's copies otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.functions.canonical import canonical, canonical_key, canonical_object, table_hash, unit_digest
from recordloom.sources.tables import assert_schema, checkpointed, declared

LOG = (
    "unit string, version int, route string, state string, digest string, copy string, sums array<struct<name:string,rows:bigint,sha256:string>>, "
    "files array<struct<path:string,size:bigint,sha256:string>>, note string, at timestamp"
)
EVIDENCE = "unit string, category string, phase string, version int, digest string, basis string, at timestamp"
FEW_UNITS = 2_000  # named one by one in a read, so that only their folders are listed
HERE = ("published", "released")  # states of units that are read from files


class StaleClaim(RuntimeError):
    """Another job published first, or a unit moved on since this job read it."""


class CopyFailed(RuntimeError):
    """A copy read again has other digests than its source."""


@dataclass(frozen=True)
class Table:
    """A table of a class: archive types of its columns, key, and the column that names the root (a bigint)."""

    kinds: dict[str, str]
    key: tuple[str, ...]
    root: str

    @property
    def schema(self) -> StructType:
        return declared(self.kinds)


@dataclass(frozen=True)
class ColdStore:
    spark: SparkSession
    folder: str
    name: str
    tables: dict[str, Table]
    schema_version: str = "1"
    now: Column = field(default_factory=F.current_timestamp)

    # --- the log ---------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        where, fs = self._path(*parts), self._files()
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def catalog_version(self) -> int:
        """The newest catalog version; 0 before the first."""
        return max([int(n.split("=")[1]) for n in self._names("log") if n.startswith("catalog_version=")], default=0)

    def log(self) -> DataFrame:
        if not self.catalog_version():
            return self.spark.createDataFrame([], LOG + ", catalog_version int")
        return self.spark.read.schema(LOG + ", catalog_version int").option("basePath", f"{self.folder}/log").parquet(f"{self.folder}/log")

    def units(self, version: int | None = None) -> DataFrame:
        """Each unit's newest log row up to a catalog version (the newest one)."""
        rows = self.log() if version is None else self.log().where(F.col("catalog_version") <= version)
        columns = rows.columns
        newest = rows.groupBy("unit").agg(F.max_by(F.struct(*columns), "catalog_version").alias("r"))
        return newest.select(*[F.col(f"r.{c}").alias(c) for c in columns])

    def publish(self, rows: DataFrame, base: int) -> int:
        """Append log rows of a job that read catalog version ``base``; the new catalog version. Fails with StaleClaim, and
        changes nothing, if another job published since."""
        if self.catalog_version() != base:
            raise StaleClaim(f"the catalog is at {self.catalog_version()}, the job read {base}")
        staged = f"staged/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.split(" ")[0]) for f in ("unit ", "version ", "route ", "state ", "digest ", "copy ", "sums ", "files ", "note ", "at ")]).coalesce(1).write.parquet(f"{self.folder}/{staged}")
        jvm = self.spark._jvm
        self._files().mkdirs(self._path("log"))
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(staged), self._path("log", f"catalog_version={base + 1}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise StaleClaim(f"another job published catalog version {base + 1}") from e
            raise
        return base + 1

    # --- rows ------------------------------------------------------------------------------------------------------

    def members(self) -> DataFrame:
        """``unit, root_id`` of all sealed units."""
        if not self._names("members"):
            return self.spark.createDataFrame([], "unit string, root_id long")
        return self.spark.read.parquet(f"{self.folder}/members").select("unit", "root_id")

    def written(self, rows: dict[str, DataFrame]) -> str:
        """Write rows (with ``unit``) of every table as a new copy; its name."""
        copy = uuid.uuid4().hex
        for name, table in self.tables.items():
            ordered = rows[name].select("unit", *table.schema.fieldNames()).repartition("unit").sortWithinPartitions("unit", *table.key)
            ordered.write.option("compression", "zstd").partitionBy("unit").parquet(f"{self.folder}/data/table={name}/copy={copy}")
        return copy

    def rows(self, name: str, units: DataFrame) -> DataFrame:
        """A table's rows with ``unit``, of log rows with a copy; only these units' folders are read."""
        table = self.tables[name]
        named = units.where("copy IS NOT NULL").select("unit", "copy")
        folder = f"{self.folder}/data/table={name}"
        if not self._names("data", f"table={name}"):
            return self.spark.createDataFrame([], StructType([*StructType.fromDDL("unit string").fields, *table.schema.fields]))
        whole = StructType([*table.schema.fields, *StructType.fromDDL("copy string, unit string").fields])
        found = self.spark.read.schema(whole).option("basePath", folder).parquet(folder)
        few = [(r.copy, r.unit) for r in named.limit(FEW_UNITS + 1).collect()]
        if len(few) <= FEW_UNITS:
            found = found.where(F.col("copy").isin([c for c, _ in few]) & F.col("unit").isin([u for _, u in few]))
        kept = found.join(named, ["unit", "copy"], "left_semi")
        return assert_schema(kept.select("unit", *table.schema.fieldNames()), StructType([*StructType.fromDDL("unit string").fields, *table.schema.fields]))

    def digests(self, rows: dict[str, DataFrame]) -> DataFrame:
        """``unit, digest, sums`` of rows in any order."""
        sums = None
        for name, table in sorted(self.tables.items()):
            fields = {c: canonical(F.col(c), kind) for c, kind in table.kinds.items()}
            told = rows[name].select("unit", canonical_key([fields[k] for k in table.key]).alias("pk"), canonical_object(fields).alias("row"))
            own = table_hash(told, ["unit"], "pk", "row").withColumn("name", F.lit(name))
            sums = own if sums is None else sums.unionByName(own)
        every = sums.select("unit").distinct().select("unit", F.explode(F.array(*[F.lit(n) for n in sorted(self.tables)])).alias("name"))
        sums = every.join(sums, ["unit", "name"], "left").select("unit", "name", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))
        listed = sums.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("name", "rows", "sha256"))).alias("sums"))
        return unit_digest(sums, ["unit"], self.name, self.schema_version).join(listed, "unit")

    def objects(self, hashed: bool = False) -> DataFrame:
        """``path, size, copy, unit`` of every file below data, and its SHA-256 if asked; else contents are not read."""
        folder = f"{self.folder}/data"
        if not self._names("data"):
            return self.spark.createDataFrame([], "path string, size long, copy string, unit string, sha256 string")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        path = F.regexp_extract("path", r"(table=[^/]+/copy=[^/]+/unit=[^/]+/[^/]+)$", 1)
        told = found.select(path.alias("path"), F.col("length").alias("size"), (F.sha2("content", 256) if hashed else F.lit(None).cast("string")).alias("sha256"))
        unit = F.url_decode(F.regexp_replace(F.regexp_extract("path", "/unit=([^/]+)/", 1), r"\+", "%2B"))
        return told.select("path", "size", F.regexp_extract("path", "/copy=([^/]+)/", 1).alias("copy"), unit.alias("unit"), "sha256")

    def _described(self, copy: str) -> DataFrame:
        """``unit, digest, sums, files`` of a copy as it lies in its files."""
        at = self.objects().where(F.col("copy") == copy).select("unit", "copy").distinct()
        files = self.objects(True).where(F.col("copy") == copy).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("path", "size", "sha256"))).alias("files"))
        return self.digests({name: self.rows(name, at) for name in self.tables}).join(files, "unit")

    # --- the life of a unit ----------------------------------------------------------------------------------------

    def seal(self, members: DataFrame, online: dict[str, DataFrame]) -> int:
        """Seal units: their members (unit, root_id) and the digest of their online rows."""
        base = self.catalog_version()
        members.select("unit", F.col("root_id").cast("long").alias("root_id")).write.parquet(f"{self.folder}/members/seal={uuid.uuid4().hex}")
        told = self.digests(self.owned(members, online))
        none = F.lit(None).cast("string")
        rows = told.select("unit", F.lit(0).alias("version"), F.lit("online").alias("route"), F.lit("sealed").alias("state"), "digest", none.alias("copy"), "sums", F.lit(None).cast("array<struct<path:string,size:bigint,sha256:string>>").alias("files"), none.alias("note"), self.now.alias("at"))
        return self.publish(rows, base)

    def owned(self, members: DataFrame, online: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Online rows of every table with the unit of their root."""
        return {name: online[name].join(members.select("unit", F.col("root_id").alias(t.root)), t.root) for name, t in self.tables.items()}

    def transfer(self, units: DataFrame, online: dict[str, DataFrame], route: str = "object", before_publish: Callable[[], None] | None = None) -> int:
        """Copy sealed units (column ``unit``) to files, read them again, and publish them if their digests are those they were
        sealed with. ``before_publish`` is called when the copy is complete and not yet visible."""
        base = self.catalog_version()
        claimed = self.units().join(units.select("unit").distinct(), "unit", "left_semi").where("state = 'sealed'")
        copy = self.written(self.owned(self.members().join(claimed.select("unit"), "unit", "left_semi"), online))
        rows = self._checked(claimed, claimed.select("unit", F.col("digest").alias("expected")), copy)
        if before_publish is not None:
            before_publish()
        return self.publish(rows.withColumn("route", F.lit(route)).withColumn("state", F.lit("published")), base)

    def _checked(self, claimed: DataFrame, expected: DataFrame, copy: str) -> DataFrame:
        """Log rows of the next versions of claimed units after their copy was compared with ``expected`` (unit, expected)."""
        told = self._described(copy)
        other = expected.join(told, "unit", "left").where(~F.col("digest").eqNullSafe(F.col("expected")))
        if bad := other.limit(5).collect():
            raise CopyFailed(f"copies differ from their source: {[r.unit for r in bad]}")
        kept = claimed.select("unit", "route", "state", (F.col("version") + 1).alias("version"))
        return kept.join(told, "unit").withColumn("copy", F.lit(copy)).withColumn("note", F.lit(None).cast("string")).withColumn("at", self.now)

    def release(self, units: DataFrame) -> int:
        """Published units become released: their online rows may go."""
        base = self.catalog_version()
        told = self.units().join(units.select("unit").distinct(), "unit", "left_semi").where("state = 'published'")
        return self.publish(told.withColumn("state", F.lit("released")).withColumn("at", self.now), base)

    def rewritten(self, units: DataFrame, edit: Callable[[str, DataFrame], DataFrame], route: str | None = None, base: int | None = None) -> int:
        """Units (column ``unit``) that are read from files, written again as their next version, with each table's rows
        changed by ``edit(table, rows)``; other units' files are not read. Their state stays. ``base`` is the catalog
        version that the job started from."""
        base = self.catalog_version() if base is None else base
        claimed = self.units(base).join(units.select("unit").distinct(), "unit", "left_semi").where(F.col("state").isin(*HERE))
        changed = {name: edit(name, self.rows(name, claimed)) for name in self.tables}
        copy = self.written(changed)
        expected = self.digests(changed).select("unit", F.col("digest").alias("expected"))
        rows = self._checked(claimed, expected, copy)
        return self.publish(rows if route is None else rows.withColumn("route", F.lit(route)), base)

    def reroute(self, units: DataFrame, route: str) -> int:
        """Move units to another route as their next version; old versions stay until ``release_old``."""
        return self.rewritten(units, lambda _, rows: rows, route)

    # --- reading ---------------------------------------------------------------------------------------------------

    def cold(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows of all units that a snapshot reads from files."""
        return self.rows(name, self.units(version).where(F.col("state").isin(*HERE)))

    def warm(self, name: str, online: DataFrame, version: int | None = None) -> DataFrame:
        """Online rows that a snapshot does not answer from files, and that are not destroyed."""
        taken = self.units(version).where(F.col("state").isin(*HERE, "destroyed")).select("unit")
        key = self.tables[name].root
        return online.join(self.members().join(taken, "unit", "left_semi").select(F.col("root_id").alias(key)), key, "left_anti")

    def intact(self, units: DataFrame) -> DataFrame:
        """``unit, ok``: whether all files of log rows are there with their size and hash."""
        wanted = units.where("files IS NOT NULL").select("unit", F.explode("files").alias("f")).select("unit", "f.*")
        there = self.objects(True).select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
        good = F.col("size").eqNullSafe(F.col("_size")) & F.col("sha256").eqNullSafe(F.col("_sha256"))
        return wanted.join(there, "path", "left").groupBy("unit").agg(F.bool_and(good).alias("ok"))

    # --- erasing and destroying ------------------------------------------------------------------------------------

    def erase(self, ids: DataFrame, columns: tuple[str, ...], online: dict[str, DataFrame], held: DataFrame | None = None, redo: bool = False) -> DataFrame:
        """Null ``columns`` of aggregates (root_id) in every table; ``root_id, unit, outcome, old, new`` with the units' digests.

        Outcomes: 'online' (in no unit: the caller erases the online rows), 'deferred' (a hold in ``held``, column unit, covers
        the unit), 'destroyed' (nothing is left), 'erased'. A sealed unit gets the digest of its online rows without the columns;
        a published or released one is written again as its next version. ``redo`` repeats an erasure after a recovery: holds
        don't count. A repeated erasure gives equal digests.
        """
        base = self.catalog_version()
        before = self.units(base).select("unit", "state", F.col("digest").alias("old"))
        asked = ids.select(F.col("root_id").cast("long").alias("root_id")).distinct()
        told = asked.join(self.members(), "root_id", "left").join(before, "unit", "left")
        stopped = F.lit(False) if held is None or redo else F.col("_held").isNotNull()
        if held is not None:
            told = told.join(held.select("unit", F.lit(1).alias("_held")).distinct(), "unit", "left")
        outcome = F.when(F.col("state").isNull(), "online").when(F.col("state") == "destroyed", "destroyed").when(stopped, "deferred").otherwise("erased")
        told = told.select("root_id", "unit", "state", "old", outcome.alias("outcome"))
        gone = told.where("outcome = 'erased'").select("root_id", "unit", "state")

        def edit(name: str, rows: DataFrame) -> DataFrame:
            return nulled(rows, self.tables[name].root, gone, columns)

        sealed = self.units(base).where("state = 'sealed'").join(gone.select("unit").distinct(), "unit", "left_semi")
        if not sealed.isEmpty():
            members = self.members().join(sealed.select("unit"), "unit", "left_semi")
            now = self.digests({name: edit(name, rows) for name, rows in self.owned(members, online).items()})
            base = self.publish(sealed.drop("digest", "sums").join(now, "unit").withColumn("at", self.now), base)
        files = gone.where(F.col("state").isin(*HERE)).select("unit").distinct()
        if not files.isEmpty():
            base = self.rewritten(files, edit, base=base)
        after = self.units(base).select("unit", F.col("digest").alias("new"))
        return told.join(after, "unit", "left").select("root_id", "unit", "outcome", "old", F.when(F.col("outcome") == "erased", F.col("new")).alias("new"))

    def evidence(self) -> DataFrame:
        if not self._names("evidence"):
            return self.spark.createDataFrame([], EVIDENCE)
        return self.spark.read.schema(EVIDENCE).parquet(f"{self.folder}/evidence")

    def _tell(self, units: DataFrame, phase: str, basis: str) -> None:
        rows = units.select("unit", F.lit("destruction").alias("category"), F.lit(phase).alias("phase"), "version", "digest", F.lit(basis).alias("basis"), self.now.alias("at"))
        rows.write.mode("append").parquet(f"{self.folder}/evidence")

    def pending(self) -> DataFrame:
        """``unit, version, digest`` of intents without an outcome."""
        told = self.evidence()
        return told.where("phase = 'intent'").join(told.where("phase <> 'intent'").select("unit", "version"), ["unit", "version"], "left_anti").select("unit", "version", "digest").distinct()

    def destroy(self, reasons: Callable[[], DataFrame], basis: str, after_intent: Callable[[], None] | None = None) -> DataFrame:
        """Destroy the units without reasons against it; ``unit, reasons, state`` of all that were considered.

        Two phases: intents go to the evidence log, ``reasons()`` (unit, reasons) is asked again, and what still has none turns
        destroyed with a tombstone, told as effective; the rest as cancelled. Only then files go. A run that ended between
        the phases is resumed first: its intents are decided like new ones; files of destroyed units are deleted again.
        """
        base = self.catalog_version()
        alive = self.units(base).where(F.col("state").isin("sealed", *HERE))
        first = alive.join(reasons().where(F.size("reasons") == 0).select("unit"), "unit", "left_semi")
        self._tell(first.join(self.pending().select("unit", "version"), ["unit", "version"], "left_anti"), "intent", basis)
        if after_intent is not None:
            after_intent()
        second = reasons()
        open_ = self.pending()
        sure = alive.join(open_, ["unit", "version", "digest"], "left_semi").join(second.where(F.size("reasons") == 0).select("unit"), "unit", "left_semi")
        if not sure.isEmpty():
            mark = F.to_json(F.struct(F.lit(basis).alias("basis"), F.lit(self.name).alias("class"), "digest", F.lit("unit").alias("scope"), "unit"))
            base = self.publish(sure.withColumn("note", mark).withColumn("state", F.lit("destroyed")).withColumn("at", self.now), base)
        done = self.units(base).where("state = 'destroyed'")
        self._tell(open_.join(done.select("unit"), "unit", "left_semi"), "effective", basis)
        self._tell(self.pending(), "cancelled", basis)
        self.purge(done)
        return alive.select("unit").join(second, "unit", "left").join(self.units(base).select("unit", "state"), "unit").select("unit", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "state")

    def purge(self, units: DataFrame) -> None:
        """Delete all files of units, whatever copy they are of; files that are gone already don't matter."""
        self._delete(self.objects().join(units.select("unit"), "unit", "left_semi"))

    def _delete(self, objects: DataFrame) -> None:
        fs = self._files()
        for r in objects.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")).distinct().toLocalIterator():
            fs.delete(self._path("data", r.folder), True)

    # --- old versions ----------------------------------------------------------------------------------------------

    def old_versions(self) -> DataFrame:
        """``unit, copy, newer_at, newer``: copies that a newer version replaced, and when and at which catalog version."""
        now = self.units().select("unit", F.col("copy").alias("current"), F.col("version").alias("now_version"))
        rows = self.log()
        newer = rows.join(now, "unit").where("version = now_version").groupBy("unit").agg(F.min("at").alias("newer_at"), F.min("catalog_version").alias("newer"))
        old = rows.where("copy IS NOT NULL").join(now, "unit").where("version < now_version AND copy <> current").select("unit", "copy").distinct()
        there = self.objects().select("unit", "copy").distinct()
        return old.join(there, ["unit", "copy"], "left_semi").join(newer, "unit")

    def release_old(self, now: Column, grace_s: int, leases: DataFrame, backup: Column) -> DataFrame:
        """Delete replaced copies; ``unit, copy, reasons`` of all of them, with what keeps a copy: 'grace' (the newer version is
        younger than ``grace_s``), 'lease' (a live lease, catalog_version and expires_at, from before it) or 'no_backup' (none
        finished after it, ``backup``)."""
        oldest = leases.where(F.col("expires_at") > now).agg(F.min("catalog_version").alias("oldest")).first().oldest
        why = F.array_compact(F.array(
            F.when(F.col("newer_at") + F.make_dt_interval(secs=F.lit(grace_s)) > now, "grace"),
            F.when(F.lit(oldest).cast("int") < F.col("newer"), "lease"),
            F.when(~F.coalesce(backup > F.col("newer_at"), F.lit(False)), "no_backup"),
        ))
        told = checkpointed(self.old_versions().select("unit", "copy", why.alias("reasons")))
        self._delete(self.objects().join(told.where(F.size("reasons") == 0).select("unit", "copy"), ["unit", "copy"], "left_semi"))
        return told

    def orphans(self, now: Column, hours: int = 24) -> DataFrame:
        """``path, size`` of files that no log row names: what jobs left that never published; ``hours`` spare running jobs."""
        named = self.log().where("copy IS NOT NULL").select("copy").distinct()
        return self.objects().join(named, "copy", "left_anti").select("path", "size")


def nulled(rows: DataFrame, key: str, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the declared columns of the aggregates in ``ids`` (root_id) null."""
    gone = ids.select(F.col("root_id").alias(key)).distinct().withColumn("_gone", F.lit(True))
    told = rows.join(gone, key, "left")
    return told.select(*[F.when(F.col("_gone").isNull(), F.col(x)).alias(x) if x in columns else F.col(x) for x in rows.columns])


def void_exports(exports: DataFrame, record_class: str, now: Column) -> DataFrame:
    """Exports after an erasure in a class: finished ones expire now, pending ones are marked to be read again."""
    own = F.col("class") == record_class
    expired = F.when(own & (F.col("state") == "done") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)), now).otherwise(F.col("expires_at"))
    return exports.withColumn("expires_at", expired).withColumn("erased_at", F.when(own & (F.col("state") == "pending"), now).otherwise(F.col("erased_at")))
