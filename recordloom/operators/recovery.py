"""Recovery and standing state: epochs that went back, redelivery gaps, checks, views of grants, units and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds that a view is good for an ordinary and for a high-risk lookup, and the drift of clocks.
READ_SECONDS = 30
HIGH_SECONDS = 5
DRIFT = 0.001


def went_back(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``consumer, generation, timeline, back`` of every consumer: whether the database's epoch is another one than that
    recorded. A consumer without a record starts here, so it did not go back."""
    last = recorded.select("consumer", F.struct("generation", "timeline").alias("_last"))
    now = F.struct("generation", "timeline")
    return current.join(last, "consumer", "left").select("consumer", "generation", "timeline", F.coalesce(F.col("_last") != now, F.lit(False)).alias("back"))



def settled(recorded: DataFrame, current: DataFrame, answered: DataFrame) -> DataFrame:
    """``consumer, generation, timeline`` recorded after a redelivery: the current epoch of consumers whose every producer answered
    (consumer, producer, answered) and of those that start for the first time; others keep what was recorded."""
    waiting = answered.groupBy("consumer").agg(F.bool_and("answered").alias("_all"))
    old = recorded.select("consumer", F.struct("generation", "timeline").alias("_old"))
    told = current.select("consumer", F.struct("generation", "timeline").alias("_now")).join(old, "consumer", "left").join(waiting, "consumer", "left")
    kept = F.when(F.col("_old").isNull() | F.coalesce("_all", F.lit(True)), F.col("_now")).otherwise(F.col("_old"))
    return told.select("consumer", kept["generation"].alias("generation"), kept["timeline"].alias("timeline"))

def resend_gaps(answers: DataFrame, subscriptions: DataFrame, progress: DataFrame) -> DataFrame:
    """Partitions that a redelivery could not cover, once for every subscription that reads the stream.

    ``answers``: stream, beyond_retention and ahead (arrays of partitions); ``subscriptions``: subscription, stream,
    repairs; ``progress``: subscription, stream, partition, progress. ``repair`` marks gaps whose read model is rebuilt.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("partitions")) for kind in ("beyond_retention", "ahead")])
    each = answers.select("stream", F.explode(kinds).alias("k")).select("stream", F.col("k.kind").alias("kind"), F.explode("k.partitions").alias("partition"))
    told = each.join(subscriptions, "stream").join(progress, ["subscription", "stream", "partition"], "left")
    repair = (F.col("kind") == "beyond_retention") & F.coalesce("repairs", F.lit(False))
    return told.select("subscription", "stream", "partition", "kind", "progress", repair.alias("repair"))


def differences(sources: DataFrame, quarantined: DataFrame, epochs: DataFrame, gaps: DataFrame, audits: DataFrame) -> DataFrame:
    """``object_type, object_id, detail`` of everything that keeps a recovery from being confirmed; no rows: it is.

    ``sources``: projection, status; ``quarantined``: projection, subject; ``epochs`` as ``went_back`` gives it; ``gaps`` as
    ``resend_gaps``; ``audits``: transfer_state, occurred_at.
    """

    def found(rows: DataFrame, kind: str, name: Column, detail: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("object_type"), name.alias("object_id"), detail.alias("detail"))

    unaligned = found(sources.where("status <> 'aligned'"), "projection", F.col("projection"), F.concat(F.lit("source "), "status"))
    held = quarantined.groupBy("projection", "subject").agg(F.count("*").alias("n"))
    subjects = found(held, "projection_subject", F.concat_ws("/", "projection", "subject"), F.format_string("quarantined: %d events", "n"))
    back = found(epochs.where("back"), "consumer_epoch", F.concat_ws(".", "generation", "timeline"), F.lit("the redelivery has not answered"))
    after = F.coalesce(F.concat(F.lit(" after "), F.col("progress").cast("string")), F.lit(""))
    missed = found(gaps, "resend_gap", F.concat("subscription", F.lit(":"), "stream", F.lit("/"), F.col("partition").cast("string")), F.concat("kind", after))
    waiting = audits.where("transfer_state IN ('pending', 'conflict')").groupBy("transfer_state").agg(F.count("*").alias("n"), F.min("occurred_at").alias("oldest"))
    since = F.date_format("oldest", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pending = F.format_string("%d records not transferred, the oldest at %s", "n", since)
    backlog = found(waiting, "audit_backlog", F.col("transfer_state"), F.when(F.col("transfer_state") == "pending", pending).otherwise(F.format_string("%d records in conflict", "n")))
    return unaligned.unionByName(subjects).unionByName(back).unionByName(missed).unionByName(backlog)


def conclusions(kept: DataFrame, commands: DataFrame) -> DataFrame:
    """Conclusions kept for a recovery with their command's state now; of a command that is gone, the state kept.

    ``kept``: reference, command, conclusion, state; ``commands``: command, state.
    """
    now = commands.select("command", F.col("state").alias("_now"))
    state = F.coalesce("_now", "state", F.lit("")).alias("state")
    return kept.join(now, "command", "left").select("reference", F.coalesce("command", F.lit("")).alias("command"), "conclusion", state)


def due_deliveries(deliveries: DataFrame, messages: DataFrame, now: Column, most: int) -> DataFrame:
    """The next delivery of each durable with its message: the first by sequence of those that wait and are due, and of
    those in flight whose lease ran out with fewer than ``most`` attempts. A purged message leaves a null subject."""
    ready = ~F.col("in_flight") & (F.col("not_before") <= now)
    expired = F.col("in_flight") & (F.col("lease_until") < now) & (F.col("attempts") < most)
    due = deliveries.where(ready | expired).groupBy("durable").agg(F.min_by(F.struct("seq", "attempts"), "seq").alias("d"))
    return due.select("durable", "d.seq", (F.col("d.attempts") + 1).alias("attempts")).join(messages.select("seq", "subject"), "seq", "left")


def regressed(held: DataFrame, following: DataFrame) -> DataFrame:
    """``view, back``: whether a view's next revisions go back in any domain, by epoch ("generation.timeline", both
    integers), then by value within one epoch. Parts that are no integers count 0 in an epoch and decide nothing as a value."""

    def epoch(text: str) -> Column:
        part = F.split(text, r"\.", 2)
        return F.struct(*[F.coalesce(F.get(part, F.lit(k)).try_cast("long"), F.lit(0).cast("long")).alias(f"e{k}") for k in range(2)])

    old = held.select("view", "domain", F.col("epoch").alias("_epoch"), F.col("value").alias("_value"))
    same = (F.col("epoch") == F.col("_epoch")) & (F.col("value").try_cast("long") < F.col("_value").try_cast("long"))
    back = (epoch("epoch") < epoch("_epoch")) | F.coalesce(same, F.lit(False))
    told = following.join(old, ["view", "domain"], "left").select("view", F.coalesce(back, F.lit(False)).alias("back"))
    return told.groupBy("view").agg(F.bool_or("back").alias("back"))


def grants(lookups: DataFrame, views: DataFrame, subjects: DataFrame) -> DataFrame:
    """``lookup, outcome, view, segments, security_version`` of every lookup: 'valid', 'stale' or 'expired'.

    ``lookups``: lookup, principal, resource_type, risk, tightening, at (seconds). ``views``: view, applicability (resource
    types), sent_at, high_at (seconds, null if never), stopped, suspended, source_stale. ``subjects``: view, principal,
    disabled, segments (structs with resource_type and name), security_version. A view is good for 30 seconds from its
    last renewal, for high risk for 5 from the last full one; of several the first by ``view`` answers. Operations that only tighten
    fall back on a stale view. A disabled account has no segments, an unknown principal version 0.
    """
    offered = views.select("*", F.explode(F.array_distinct("applicability")).alias("resource_type"))
    high = F.col("risk") == "high"
    until = F.when(high, F.col("high_at") + HIGH_SECONDS * (1 - DRIFT)).otherwise(F.col("sent_at") + READ_SECONDS * (1 - DRIFT))
    open_ = ~F.col("stopped") & ~F.col("suspended")
    valid = F.coalesce(open_ & (F.col("at") < until), F.lit(False))
    stale = F.coalesce(F.col("tightening") & open_ & F.col("source_stale") & F.col("high_at").isNotNull(), F.lit(False))
    choice = F.when(valid, F.struct(F.lit(0).alias("rank"), "view")).when(stale, F.struct(F.lit(1).alias("rank"), "view"))
    asked = lookups.join(offered, "resource_type", "left").withColumn("_choice", choice)
    best = asked.groupBy("lookup", "principal", "resource_type").agg(F.min("_choice").alias("_best"))
    told = best.select("*", F.col("_best.view").alias("view")).join(subjects, ["view", "principal"], "left")
    fitting = F.filter("segments", lambda s: (s["resource_type"] == "") | (s["resource_type"] == F.col("resource_type")))
    names = F.array_sort(F.transform(F.when(~F.col("disabled"), fitting), lambda s: s["name"]))
    outcome = F.when(F.col("_best.rank") == 0, "valid").when(F.col("_best.rank") == 1, "stale").otherwise("expired")
    return told.select("lookup", outcome.alias("outcome"), "view", F.coalesce(names, F.array().cast("array<string>")).alias("segments"), F.coalesce("security_version", F.lit(0).cast("long")).alias("security_version"))


def blocked_since(units: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """``units`` (unit, blocked_since) with the time a blocked unit came due: its latest anchor and the residence, kept
    while it stays blocked. ``anchors``: unit, anchor of the members of the units that are blocked now; others are open again."""
    due = anchors.groupBy("unit").agg((F.max("anchor") + F.make_dt_interval(F.lit(days))).alias("_due"))
    return units.join(due, "unit", "left").select("unit", F.when(F.col("_due").isNotNull(), F.coalesce("blocked_since", "_due")).alias("blocked_since"))


def open_units(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """``class, grouping, seq, created``: the open unit of each wanted grouping, or the next number of a new one."""
    known = units.groupBy("class", "grouping").agg(F.max(F.when(F.col("state") == "open", F.col("seq"))).alias("_open"), F.max("seq").alias("_last"))
    told = wanted.select("class", "grouping").distinct().join(known, ["class", "grouping"], "left")
    seq = F.coalesce("_open", F.coalesce("_last", F.lit(0)) + 1)
    return told.select("class", "grouping", seq.cast("long").alias("seq"), F.col("_open").isNull().alias("created"))


def export_status(asked: DataFrame, exports: DataFrame, now: Column) -> DataFrame:
    """Status of the exports asked for, told to their requester only and until they expire: others find none (null state).
    ``asked``: export, principal; ``exports``: export, principal, state, rows, expires_at."""
    alive = exports.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return asked.join(alive.select("export", "principal", "state", "rows"), ["export", "principal"], "left")


def expired_exports(exports: DataFrame, now: Column) -> DataFrame:
    """Exports whose row and object a cleanup removes."""
    return exports.where(F.col("expires_at") <= now)


def located(asked: DataFrame, members: DataFrame, units: DataFrame, cold: DataFrame) -> DataFrame:
    """``root_id, outcome, unit`` of every root asked for: 'destroyed', 'not_here' (online, or no member), 'found', or
    'unavailable' where the catalog names a unit whose copy lacks the root. ``cold``: unit, root_id of the copies."""
    there = cold.select("unit", "root_id", F.lit(True).alias("_there")).distinct()
    told = asked.select("root_id").distinct().join(members.select("root_id", "unit"), "root_id", "left").join(units.select("unit", "state", "route"), "unit", "left")
    outcome = (
        F.when(F.col("state") == "destroyed", "destroyed").when(F.col("route").isNull() | (F.col("route") == "online"), "not_here")
        .when(F.col("_there"), "found").otherwise("unavailable")
    )
    return told.join(there, ["unit", "root_id"], "left").select("root_id", outcome.alias("outcome"), "unit")


def completed(runs: DataFrame, now: Column) -> DataFrame:
    """Runs after their completion: a singleton waits for its next run after its interval, others are done.

    ``runs``: run, singleton, interval_s, attempts, progress; ``run_at`` and ``finished_at`` are null where they don't apply.
    """
    again = F.col("singleton")
    return runs.select(
        "run", F.when(again, "pending").otherwise("done").alias("state"), F.when(again, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~again, F.col("progress")).alias("progress"), F.when(again, now + F.make_dt_interval(secs=F.col("interval_s"))).alias("run_at"), F.when(~again, now).alias("finished_at"),
    )
