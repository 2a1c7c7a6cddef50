"""Joins of records: aggregates and their children, holds, holders, presence and reconciliation.

All joins have an equality, so none becomes a nested loop; conditions with OR are unions of semi joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """A table of an aggregate: the name of its parent's table, its column and the parent's key."""

    name: str
    parent: str
    foreign_key: str
    parent_key: str


def by_depth(root: str, children: list[Child]) -> list[Child]:
    """Children after their parents; within a level by name."""
    level = {root: 0}
    while len(level) <= len(children):
        ready = [c for c in children if c.name not in level and c.parent in level]
        if not ready:
            raise ValueError("a child table has no parent")
        level |= {c.name: level[c.parent] + 1 for c in ready}
    return sorted(children, key=lambda c: (level[c.name], c.name))


def with_roots(tables: dict[str, DataFrame], root: str, root_key: str, children: list[Child]) -> dict[str, DataFrame]:
    """Every table with the column ``root_id`` of the aggregate that its rows belong to; orphans are left out."""
    found = {root: tables[root].withColumn("root_id", F.col(root_key))}
    for child in by_depth(root, children):
        parents = found[child.parent].select(F.col(child.parent_key).alias(child.foreign_key), "root_id").distinct()
        found[child.name] = tables[child.name].join(parents, child.foreign_key)
    return found


def assembled(tables: dict[str, DataFrame], root: str, root_key: str, children: list[Child]) -> DataFrame:
    """``root_id, root`` and one sorted array of rows for each child table; aggregates are small by the sealing rule."""
    rooted = with_roots(tables, root, root_key, children)
    out = rooted[root].select("root_id", F.struct(*tables[root].columns).alias(root))
    for child in by_depth(root, children):
        rows = rooted[child.name].groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct(*sorted(tables[child.name].columns)))).alias(child.name))
        out = out.join(rows, "root_id", "left").withColumn(child.name, F.coalesce(child.name, F.array().cast(rows.schema[child.name].dataType)))
    return out


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of a copy whose parent is missing: none in a complete one."""
    return child.join(parent.select(F.col(parent_key).alias(foreign_key)), foreign_key, "left_anti")


def online(roots: DataFrame, root_key: str, members: DataFrame, units: DataFrame, version: int) -> DataFrame:
    """Online roots that a snapshot of the archive at ``version`` does not answer for."""
    cold = units.where(((F.col("route") != "online") & (F.col("route_version") <= version)) | (F.col("state") == "destroyed"))
    taken = members.join(cold.select("unit"), "unit", "left_semi").select(F.col("root_id").alias(root_key))
    return roots.join(taken, root_key, "left_anti")


def covering(units: DataFrame, scopes: DataFrame, members: DataFrame) -> DataFrame:
    """``unit, holds``: live holds on a unit, on its class, or on any of its records, as one equality join each."""
    live = scopes.where("released_at IS NULL").select("hold_id", "scope_kind", "scope")
    on_unit = units.join(live.where("scope_kind = 'unit'"), F.col("unit") == F.col("scope")).select("unit", "hold_id")
    on_class = units.join(live.where("scope_kind = 'class'"), F.col("class") == F.col("scope")).select("unit", "hold_id")
    records = members.join(units.select("unit", "class"), "unit").select("unit", F.concat_ws("/", "class", F.col("root_id").cast("string")).alias("scope"))
    on_record = records.join(live.where("scope_kind = 'record'"), "scope").select("unit", "hold_id")
    hits = on_unit.unionByName(on_class).unionByName(on_record).distinct().groupBy("unit").agg(F.count("*").alias("holds"))
    return units.select("unit").join(hits, "unit", "left").select("unit", F.coalesce("holds", F.lit(0)).alias("holds"))


def holders(appointments: DataFrame, links: DataFrame, on: Column, position: list[str]) -> DataFrame:
    """``position, account``: accounts whose employees hold a position on a date; an open end counts as held.

    ``appointments``: employee_id, position columns, state, start_date, end_date; ``links``: employee_id, account, state.
    """
    held = appointments.where(F.col("state").isin("planned", "active") & (F.col("start_date") <= on) & (F.col("end_date").isNull() | (F.col("end_date") >= on)))
    accounts = links.where("state = 'active' AND account IS NOT NULL").select("employee_id", "account")
    return held.select("employee_id", *position).join(accounts, "employee_id").select(*position, "account").distinct()


def presence(asked: DataFrame, current: DataFrame) -> DataFrame:
    """``id, answer, version`` for every asked id (and wanted version): present, older or absent."""
    rows = asked.join(current.select("id", F.col("version").alias("found")), "id", "left")
    answer = F.when(F.col("found").isNull(), "absent").when(F.col("found") < F.col("version"), "older").otherwise("present")
    return rows.select("id", answer.alias("answer"), F.col("found").alias("version"))


def batch_read(asked: DataFrame, live: DataFrame, gone: DataFrame) -> DataFrame:
    """``place, id, state, version`` in the order asked: exists, tombstone or purged, never omitted.

    ``asked``: place, id; ``live``: id, version; ``gone``: id, version of the deletion.
    """
    rows = asked.join(live.select("id", F.col("version").alias("live_version")), "id", "left").join(gone.select("id", F.col("version").alias("gone_version")), "id", "left")
    state = F.when(F.col("live_version").isNotNull(), "exists").when(F.col("gone_version").isNotNull(), "tombstone").otherwise("purged")
    return rows.select("place", "id", state.alias("state"), F.coalesce("live_version", "gone_version", F.lit(0)).alias("version"))


def high_water(streams: DataFrame, counters: DataFrame) -> DataFrame:
    """``stream, partition, high`` for every partition of every stream; 0 where the current epoch has numbered nothing.

    ``streams``: stream, partitions, generation, timeline; ``counters``: stream, partition, generation, timeline, last_seq.
    """
    keys = ["stream", "partition", "generation", "timeline"]
    every = streams.withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)))
    return every.join(counters, keys, "left").select("stream", "partition", F.coalesce("last_seq", F.lit(0)).alias("high"))


def judged(asked: DataFrame, rows: DataFrame, source: dict[str, Column]) -> DataFrame:
    """``id, verdict`` of projected rows against their source's state, first matching rule wins.

    ``source``: columns or literals ``watermarked, state, projection_serving, last_applied, age, freshness``;
    ``rows``: id, state, adopted; ``asked``: id, quarantined.
    """
    joined = asked.join(rows.select("id", F.col("state").alias("row_state"), "adopted"), "id", "left")
    aligned = (source["state"] == "aligned") | (source["last_applied"] & (source["state"] == "stalled"))
    fresh = source["last_applied"] | (source["age"].isNotNull() & (source["age"] <= source["freshness"]))
    verdict = (
        F.when(~source["watermarked"], "query_the_source")
        .when(~aligned | ~source["projection_serving"] | F.col("quarantined"), "unprovable")
        .when(~F.coalesce(fresh, F.lit(False)), "unprovable")
        .when(F.col("row_state").isNull(), "provably_absent")
        .when(~F.col("adopted"), "unprovable")
        .when(F.col("row_state") == "complete", "usable")
        .when(F.col("row_state") == "tombstone", "provably_absent")
        .otherwise("unprovable")
    )
    return joined.select("id", verdict.alias("verdict"))


FINAL = ("succeeded", "failed", "rejected")


def reconciled(open_: DataFrame, external: DataFrame, local: DataFrame, issued: DataFrame, recovery_point: Column, unrecorded_until: Column, now: Column) -> DataFrame:
    """``reference, conclusion, state``: what becomes of every reference after a recovery, first matching rule wins.

    ``open_``: reference, state, first_reached, last_reached, sending_at, expires_at, dedupe_s, last_use, processing_s
    (seconds; 0: not offered); ``external``: reference, state; ``local`` and ``issued``: reference.
    """
    outside = external.select("reference", F.col("state").alias("external_state"))
    first = F.coalesce("first_reached", "sending_at", recovery_point)
    base = F.when(F.col("last_use") & F.col("last_reached").isNotNull(), F.col("last_reached")).otherwise(first)
    margin = F.greatest(F.col("dedupe_s") / 10, F.lit(3600.0))
    deadline = F.when(F.col("dedupe_s") > 0, seconds_after(base, F.col("dedupe_s") - margin))
    latest = F.greatest(F.col("last_reached"), unrecorded_until)
    landed = (F.col("expires_at") < now) | ((F.col("processing_s") > 0) & (seconds_after(latest, F.col("processing_s")) < now))
    conclusion = (
        F.when(F.col("external_state").isNotNull(), "matched")
        .when(F.col("state") == "manual", "manual")
        .when(deadline >= now, "deadline")
        .when(F.coalesce(landed, F.lit(False)), "unknown")
        .otherwise("manual")
    )
    state = F.when(F.col("external_state").isin(*FINAL), F.col("external_state")).when(F.col("external_state").isNotNull(), "accepted")
    ours = open_.join(outside, "reference", "left").select("reference", conclusion.alias("conclusion"), state.alias("state"))
    known = local.select("reference").unionByName(open_.select("reference")).distinct()
    only = external.select("reference").join(known, "reference", "left_anti").distinct().select("reference", F.lit("external_only").alias("conclusion"))
    seen = known.unionByName(external.select("reference"))
    maybe = issued.select("reference").join(seen, "reference", "left_anti").distinct().select("reference", F.lit("possibly_executed").alias("conclusion"))
    return ours.unionByName(only.unionByName(maybe).withColumn("state", F.lit(None).cast("string")))


def seconds_after(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
