"""Audit and evidence records: masked changes, transfer and replay, trust and recovery checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.folds import closure


def masked_changes(changes: Column, restricted: Column) -> Column:
    """A map of changes in which the values of restricted fields (an array of names) are digests."""
    return F.transform_values(changes, lambda k, v: F.when(F.array_contains(restricted, k) & v.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(v.alias("v"))), 256))).otherwise(v))


def drained(outbox: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, stopped): records that stay in the outbox, and those a receiver refused with its reason.

    ``statuses``: id, status ('accepted', 'duplicate' or another, which stops a record), reason.
    """
    told = outbox.join(statuses, "id", "left")
    done = F.col("status").isin("accepted", "duplicate")
    left = told.where(~F.coalesce(done, F.lit(False)))
    return left.drop("status", "reason"), left.where("status IS NOT NULL").select("id", "status", "reason")


def replayed(records: DataFrame, history: DataFrame) -> DataFrame:
    """``records`` with ``outcome``: 'reflected' if the change history holds their identity, 'apply' for the first of an
    identity that is not there, 'repeat' for the others."""
    from pyspark.sql import Window

    seen = records.join(history.select("identity", F.lit(True).alias("there")).distinct(), "identity", "left")
    first = F.row_number().over(Window.partitionBy("identity").orderBy("seq")) == 1
    return seen.withColumn("outcome", F.when(F.col("there"), "reflected").when(first, "apply").otherwise("repeat")).drop("there")


def trusted(configured: DataFrame, rotations: DataFrame) -> DataFrame:
    """``node``: authorities trusted: the configured ones and, back along rotations with both signatures, their predecessors.

    ``configured``: node; ``rotations``: previous, next, signed, accepted.
    """
    edges = rotations.where("signed AND accepted").select(F.col("next").alias("source"), F.col("previous").alias("target"))
    return closure(configured, edges)


def held_at(records: DataFrame, revocations: DataFrame, skew: Column) -> DataFrame:
    """Records (fingerprint, received) whose signer was not revoked when they came; a revocation counts from ``skew``
    before it was received, the earliest of a fingerprint decides."""
    earliest = revocations.groupBy("fingerprint").agg(F.min("received").alias("revoked"))
    told = records.join(earliest, "fingerprint", "left")
    return told.where(F.col("revoked").isNull() | (F.col("received") <= F.col("revoked") - skew)).drop("revoked")


def blockers(roots: DataFrame, outbox: DataFrame, others: DataFrame) -> DataFrame:
    """``root_id, reasons``: what keeps aggregates from being sealed: unpublished events, and what modules say (root_id, reason)."""
    waiting = roots.select("root_id").join(outbox.where("published_at IS NULL").select(F.col("record_id").alias("root_id")), "root_id", "left_semi").withColumn("reason", F.lit("unpublished_events"))
    said = others.join(roots.select("root_id"), "root_id", "left_semi").select("root_id", "reason")
    return waiting.unionByName(said).groupBy("root_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def routes(units: DataFrame, thaws: DataFrame, now: Column) -> DataFrame:
    """``units`` with ``effective``: 'thawed' while a thaw is live, else the unit's route."""
    live = thaws.where(F.col("until") > now).groupBy("unit").agg(F.max("until").alias("until"))
    told = units.join(live, "unit", "left")
    return told.withColumn("effective", F.when(F.col("until").isNotNull(), "thawed").otherwise(F.col("route"))).drop("until")


def approved(units: DataFrame, approvals: DataFrame) -> DataFrame:
    """``unit, approved``: whether a live approval covers a unit itself or its class; two semi joins in place of an OR."""
    live = approvals.where("withdrawn_at IS NULL")
    own = units.join(live.where("scope_kind = 'unit'").select(F.col("scope").alias("unit")), "unit", "left_semi").select("unit")
    standing = units.join(live.where("scope_kind = 'class'").select(F.col("scope").alias("class")), "class", "left_semi").select("unit")
    yes = own.unionByName(standing).distinct().withColumn("approved", F.lit(True))
    return units.select("unit").join(yes, "unit", "left").select("unit", F.coalesce("approved", F.lit(False)).alias("approved"))


def series_maxima(used: DataFrame) -> DataFrame:
    """``legal_entity, code, period, max_used`` of gapless series keyed '<entity>/<code>/<period>' (the period may hold slashes)."""
    parts = F.split("series", "/", 3)
    return used.groupBy("series").agg(F.max("number").alias("max_used")).select(parts[0].alias("legal_entity"), parts[1].alias("code"), F.coalesce(F.get(parts, 2), F.lit("")).alias("period"), "max_used")


def check_outcome(differences: Column, failed: Column) -> Column:
    """Outcome of a recovery check: a check that could not run proves nothing."""
    return F.when(failed, "unprovable").when(differences > 0, "diff").otherwise("pass")
