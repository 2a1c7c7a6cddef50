"""Projections: local copies of another component's records, folded from its events.

Versions, not arrival times, settle late data. Where only whole and deleting inputs of one instance and epoch come,
the greatest version wins and the fold is an aggregation that combines before the shuffle. Partial inputs depend on
their order and are folded per record: one record's inputs are bounded by its own history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "record_id string, state string, version long, need_version long, impl string, epoch string, data string"


def admissible(inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """``inputs`` with ``skipped``: null, or why an input is not applied to a projection that adopted a source.

    ``sources``: projection, impl, epoch (null impl: never aligned).
    """
    from recordloom.functions.keys import epoch_of

    joined = inputs.join(sources.select("projection", F.col("impl").alias("own_impl"), F.col("epoch").alias("own_epoch")), "projection", "left")
    ours, theirs = epoch_of(F.col("own_epoch")), epoch_of(F.col("epoch"))
    why = (
        F.when(F.col("own_impl").isNull(), F.lit(None))
        .when(F.col("impl") != F.col("own_impl"), "other_instance")
        .when(theirs < ours, "older_epoch")
        .when(theirs > ours, "newer_epoch")
    )
    return joined.withColumn("skipped", why).drop("own_impl", "own_epoch")


def fold_whole(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, state, version`` after inputs of kind full or delete: the greatest version, a deletion on ties."""
    top = inputs.groupBy(*keys).agg(F.max(F.struct("version", (F.col("kind") == "delete").alias("gone"))).alias("top"))
    return top.select(*keys, F.when(F.col("top.gone"), "tombstone").otherwise("complete").alias("state"), F.col("top.version").alias("version"))


def fold_record(row: dict[str, Any] | None, inputs: Iterator[dict[str, Any]]) -> dict[str, Any] | None:
    """One record's row after its inputs in order; the rules are those of ``decisions.projection_row``."""
    for i in inputs:
        kind, v = i["kind"], i["version"]
        old = row is not None and (row["impl"], row["epoch"]) != (i["impl"], i["epoch"])
        base = {"impl": i["impl"], "epoch": i["epoch"], "version": v, "need_version": None, "data": i["data"]}
        if kind == "purged":
            row = base | {"state": "tombstone", "version": 0, "data": None}
        elif row is None or old:
            state = {"full": "complete", "partial": "incomplete"}.get(kind, "tombstone")
            keep = kind == "full" or (kind == "partial" and row is None)
            row = base | {"state": state, "need_version": v if kind == "partial" else None, "data": i["data"] if keep else None}
        elif row["state"] == "tombstone":
            if v > row["version"]:
                state = {"full": "complete", "partial": "incomplete"}.get(kind, "tombstone")
                row = base | {"state": state, "need_version": v if kind == "partial" else None, "data": i["data"] if kind == "full" else None}
        elif kind == "full" and ((row["state"] == "complete" and v > row["version"]) or (row["state"] == "incomplete" and v >= row["need_version"])):
            row = base | {"state": "complete"}
        elif kind == "partial" and v > row["version"]:
            fields = json.loads(row["data"] or "{}") | json.loads(i["data"] or "{}")
            row = base | {"state": "incomplete", "need_version": v, "data": json.dumps(fields, sort_keys=True, ensure_ascii=False)}
        elif kind == "delete" and v >= row["version"]:
            row = base | {"state": "tombstone", "data": None}
    return row


def fold_ordered(inputs: DataFrame, order: list[str]) -> DataFrame:
    """STATE of every record after all its inputs (record_id, kind, version, impl, epoch, data) in ``order``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").astype(object)
        row = fold_record(None, iter(pdf.where(pdf.notna(), None).to_dict("records")))
        return pd.DataFrame([{"record_id": pdf["record_id"].iloc[0]} | row])[[c.split()[0] for c in STATE.split(", ")]]

    names = list(dict.fromkeys(["record_id", "kind", "version", "impl", "epoch", "data", *order]))
    return inputs.select(*names).groupBy("record_id").applyInPandas(fold, STATE)


def fold_stream(inputs: DataFrame, order: list[str]) -> DataFrame:
    """The streaming twin: each micro-batch's changed rows, the state of a record kept between batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = json.loads(state.get[0]) if state.exists else None
        whole = pd.concat(list(batches)).sort_values(order, kind="stable").astype(object)
        after = fold_record(row, iter(whole.where(whole.notna(), None).to_dict("records")))
        if after != row:
            state.update((json.dumps(after),))
            yield pd.DataFrame([{"record_id": key[0]} | after])[[c.split()[0] for c in STATE.split(", ")]]

    return inputs.groupBy("record_id").applyInPandasWithState(fold, STATE, "row string", "update", GroupStateTimeout.NoTimeout)


def aligned(local: DataFrame, snapshot: DataFrame, answers: DataFrame, generation: int) -> DataFrame:
    """``record_id, state, version, aligned_gen`` after a full alignment.

    The snapshot overwrites rows whatever their version, but rows written during this alignment only by a newer one.
    Rows that the snapshot lacks are read by id (``answers``: exists, tombstone or purged, never omitted).
    ``local``: record_id, state, version, aligned_gen; ``snapshot``: record_id, version.
    """
    left = local.where(~F.col("aligned_gen").eqNullSafe(F.lit(generation))).join(snapshot.select("record_id"), "record_id", "left_anti").select("record_id")
    read = answers.join(left, "record_id", "left_semi").select(
        "record_id", F.when(F.col("state") == "exists", "complete").otherwise("tombstone").alias("new_state"), F.when(F.col("state") == "purged", 0).otherwise(F.col("version")).cast("long").alias("new_version")
    )
    puts = snapshot.select("record_id", F.lit("complete").alias("new_state"), F.col("version").alias("new_version")).unionByName(read)
    both = local.join(puts, "record_id", "full")
    takes = F.col("new_version").isNotNull() & (F.col("version").isNull() | ~F.col("aligned_gen").eqNullSafe(F.lit(generation)) | (F.col("version") < F.col("new_version")))
    return both.select(
        "record_id",
        F.when(takes, F.col("new_state")).otherwise(F.col("state")).alias("state"),
        F.when(takes, F.col("new_version")).otherwise(F.col("version")).alias("version"),
        F.when(takes, F.lit(generation)).otherwise(F.col("aligned_gen")).alias("aligned_gen"),
    )


def tripped(inputs: DataFrame, rows: DataFrame) -> DataFrame:
    """Inputs that show a rollback of their source: the same version of a record with another content."""
    known = rows.select("record_id", "version", F.col("digest").alias("known_digest"))
    return inputs.join(known, ["record_id", "version"]).where("digest <> known_digest")


def tripwires(pulled: DataFrame, rows: DataFrame, asked: DataFrame, counters: DataFrame, outbox: DataFrame) -> DataFrame:
    """``trip, stream_partition, id``: everything that shows a rollback of a source, in one pass over each table.

    ``content``: an input (pulled: impl, epoch, partition, record_id, version, digest) of a complete row (rows: impl, epoch,
    record_id, version, state, digest) of the same instance, epoch and version with another content. ``position``: a
    consumer's position (asked: partition, impl, epoch, seq, record_id, version, digest) above the partition's counter
    (counters: partition, impl, epoch, seq). ``identity``: at the position stands another row (outbox: partition, impl, epoch, seq,
    record_id, version, digest). A position of another instance or epoch, or of a row that retention removed, shows nothing.
    """
    complete = rows.where("state = 'complete'").select("impl", "epoch", "record_id", "version", F.col("digest").alias("known"))
    content = pulled.join(complete, ["impl", "epoch", "record_id", "version"]).where("digest <> known").select(F.lit("content").alias("trip"), F.col("partition").alias("stream_partition"), F.col("record_id").alias("id"))
    named = asked.join(counters.select("partition", "impl", "epoch", F.col("seq").alias("counter")), ["partition", "impl", "epoch"])
    beyond = named.where("seq > counter").select(F.lit("position").alias("trip"), F.col("partition").alias("stream_partition"), F.col("record_id").alias("id"))
    there = outbox.select("partition", "impl", "epoch", "seq", F.struct("record_id", "version", "digest").alias("found"))
    other = named.where("seq <= counter").join(there, ["partition", "impl", "epoch", "seq"]).where(~F.struct("record_id", "version", "digest").eqNullSafe(F.col("found")))
    return content.unionByName(beyond).unionByName(other.select(F.lit("identity").alias("trip"), F.col("partition").alias("stream_partition"), F.col("record_id").alias("id"))).distinct()


def align_watermark(local: DataFrame, snapshot: DataFrame, answers: DataFrame, generation: int, echoes: DataFrame, quarantine: DataFrame, adopted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, positions, quarantine) of a projection after its source was fetched again; the three move together.

    ``echoes`` (partition, p0) come from a pull before the snapshot: they are the positions (partition, seq) of the new
    state. Rows follow ``aligned``, but a purged record's tombstone has the version of its partition's P0 (``local`` and
    ``answers`` have ``partition``). Quarantined subjects (projection, subject, impl, epoch, partition, seq) stay only if they come
    from the adopted instance and epoch (``adopted``: projection, impl, epoch) after P0: the snapshot brought the others.
    """
    purged = answers.join(echoes, "partition", "left").withColumn("version", F.when(F.col("state") == "purged", F.col("p0")).otherwise(F.col("version")))
    told = purged.withColumn("state", F.when(F.col("state") == "purged", "tombstone").otherwise(F.col("state"))).select("record_id", "state", "version")
    rows = aligned(local.drop("partition"), snapshot, told, generation)
    positions = echoes.select("partition", F.col("p0").alias("seq"))
    after = quarantine.join(adopted, ["projection", "impl", "epoch"], "left_semi").join(echoes, "partition", "left")
    kept = after.where(F.col("p0").isNull() | (F.col("seq") > F.col("p0"))).select(*quarantine.columns)
    return rows, positions, kept


def pull_page(outbox: DataFrame, positions: DataFrame, echoes: DataFrame, size: int = 500) -> DataFrame:
    """Rows of each partition after the consumer's position and up to its echo, ``size`` at most; ``last`` marks a
    partition's last page, which carries the echo. ``positions``: partition, after; ``echoes``: partition, echo."""
    from recordloom.streaming.outbox import after_positions

    rows = after_positions(outbox, positions, size).join(echoes, "partition").where("seq <= echo")
    return rows.withColumn("last", F.col("seq") == F.col("echo")).drop("first", "after", "echo")


def resent(outbox: DataFrame, starts: DataFrame) -> DataFrame:
    """Published rows after each partition's start, in position order; partitions without a start from the first row.

    ``outbox`` has ``position`` structs; ``starts``: stream, partition, position.
    """
    joined = outbox.join(starts.select("stream", "partition", F.col("position").alias("start")), ["stream", "partition"], "left")
    return joined.where(F.col("start").isNull() | (F.col("position") > F.col("start"))).drop("start")


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows that a retention of ``days`` still keeps."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))
