"""The archive: sealing, copying, publishing, reading history across online and cold rows, erasing and checking.

State is versions and manifests, never updates in place: a job writes a new version beside the old one and a
manifest row makes it visible, so a job that fails leaves nothing that a reader would see.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.canonical import canonical, canonical_key, canonical_object, table_hash, unit_digest
from recordloom.functions.keys import period
from recordloom.operators.policy import Plan, Resource, masked
from recordloom.operators.relations import online

MOST_MEMBERS = 100_000


@dataclass(frozen=True)
class ArchiveClass:
    """A class of aggregates: the root's key, grouping columns, anchor, terminal condition and residence."""

    name: str
    root_key: str
    grouping: tuple[str, ...]
    anchor: str
    terminal: str
    residence_days: int | None  # None: never leaves the online tables
    erasable: tuple[str, ...] = ()
    schema_version: str = "1"


def candidates(roots: DataFrame, members: DataFrame, c: ArchiveClass, now: Column) -> DataFrame:
    """Roots that may be sealed: terminal, past the residence, not members yet; with ``period``."""
    if c.residence_days is None:
        return roots.limit(0).withColumn("period", F.lit(""))
    due = F.col(c.anchor) <= now - F.make_dt_interval(F.lit(c.residence_days))
    ready = roots.where(F.expr(c.terminal) & due)
    fresh = ready.join(members.select(F.col("root_id").alias(c.root_key)), c.root_key, "left_anti")
    return fresh.withColumn("period", period(F.col(c.anchor)))


def groupings(found: DataFrame, c: ArchiveClass) -> DataFrame:
    """``grouping columns, period, members, anchor_max`` of the candidates."""
    return found.groupBy(*c.grouping, "period").agg(F.count("*").alias("members"), F.max(c.anchor).alias("anchor_max"))


def units_of(found: DataFrame, c: ArchiveClass, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, members) sealed from candidates: a unit per grouping and MOST_MEMBERS of its roots.

    Groupings with a blocked root (``blocked``: root_id, reason) stay. Roots are dealt to a grouping's units by a hash,
    so a large grouping is no single task; the units of one grouping are near equal and below the limit.
    """
    keys = [*c.grouping, "period"]
    if blocked is not None:
        held = found.join(blocked.select(F.col("root_id").alias(c.root_key)), c.root_key, "left_semi").select(*keys).distinct()
        found = found.join(held, keys, "left_anti")
    sizes = found.groupBy(*keys).agg(F.ceil(F.count("*") / (MOST_MEMBERS * 0.9)).alias("parts"))
    dealt = found.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(c.root_key), F.col("parts")))
    dealt = dealt.withColumn("unit", F.concat_ws("~", F.lit(c.name), *keys, F.col("part").cast("string")))
    members = dealt.select("unit", F.col(c.root_key).alias("root_id"))
    units = dealt.groupBy("unit", *keys).agg(F.count("*").alias("members"), F.max(c.anchor).alias("anchor_max"))
    return units.withColumn("class", F.lit(c.name)).withColumn("state", F.lit("sealed")), members


def canonical_rows(rows: DataFrame, kinds: dict[str, str], key: list[str]) -> DataFrame:
    """``unit, pk, row``: canonical key and row bytes of a table (column: archive type), nulls left out of rows."""
    fields = {name: canonical(F.col(name), kind) for name, kind in kinds.items()}
    return rows.select("unit", canonical_key([fields[k] for k in key]).alias("pk"), canonical_object(fields).alias("row"))


def digests(tables: dict[str, tuple[DataFrame, dict[str, str], list[str]]], c: ArchiveClass) -> tuple[DataFrame, DataFrame]:
    """(sums, digests): ``unit, name, rows, sha256`` of every table and ``unit, digest`` over them, from rows in any order."""
    sums = None
    for name, (rows, kinds, key) in sorted(tables.items()):
        own = table_hash(canonical_rows(rows, kinds, key), ["unit"], "pk", "row").withColumn("name", F.lit(name))
        sums = own if sums is None else sums.unionByName(own)
    return sums, unit_digest(sums, ["unit"], c.name, c.schema_version)


def history(online_rows: DataFrame, cold_rows: DataFrame, c: ArchiveClass, members: DataFrame, units: DataFrame, version: int, resource: Resource, plan: Plan) -> DataFrame:
    """What a subject sees of a class at one snapshot: each aggregate once, from online rows or from its cold unit.

    Online rows of units that the snapshot answers from the archive are left out; cold rows come from units whose route
    is at most the snapshot's. The policy is one predicate over both, so it is pushed into both scans.
    """
    warm = online(online_rows, c.root_key, members, units, version)
    readable = units.where((F.col("route") != "online") & (F.col("route_version") <= version) & (F.col("state") != "destroyed"))
    cold = cold_rows.join(readable.select("unit"), "unit", "left_semi").drop("unit")
    both = warm.select(*cold.columns).unionByName(cold).where(plan.where)
    return masked(both, resource, plan.readable())


def erased(rows: DataFrame, key: str, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A table's next version: the declared columns of the erased aggregates are null."""
    gone = ids.select(F.col("root_id").alias(key)).distinct().withColumn("_gone", F.lit(True))
    told = rows.join(gone, key, "left")
    return told.select(*[F.when(F.col("_gone").isNull(), F.col(x)).alias(x) if x in columns else F.col(x) for x in rows.columns])


def released(rows: DataFrame, key: str, members: DataFrame, units: DataFrame) -> DataFrame:
    """Online rows after a release: those of members of released units are gone."""
    done = members.join(units.where("state = 'released'").select("unit"), "unit", "left_semi")
    return rows.join(done.select(F.col("root_id").alias(key)), key, "left_anti")


def barrier(changes: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Changes of sealed aggregates; a write job fails unless there are none."""
    return changes.join(members.select(F.col("root_id").alias(key)), key, "left_semi")


def left_online(roots: DataFrame, key: str, members: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, rows``: released units that still have online rows."""
    done = members.join(units.where("state = 'released'").select("unit"), "unit")
    return done.join(roots.select(F.col(key).alias("root_id")), "root_id").groupBy("unit").agg(F.count("*").alias("rows"))
