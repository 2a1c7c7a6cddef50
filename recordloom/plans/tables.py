"""Decision tables as queries: every event is a situation, decided in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import decisions as d
from recordloom.plans.queries import registered
from recordloom.sources.tables import read


MOST_DEALT = 4_000  # combinations that events are dealt over; further columns take all their values for each event


def dealt(values: dict[str, list]) -> tuple[list[tuple[str, list, int]], list[tuple[str, list]]]:
    """(columns whose value follows from the event's number, with the stride of each; columns that take every value)."""
    own, rest, stride = [], [], 1
    for name, options in values.items():
        if not rest and stride * len(options) <= MOST_DEALT:
            own.append((name, options, stride))
            stride *= len(options)
        else:
            rest.append((name, options))
    return own, rest


def grid(spark: SparkSession, sf: str, **values: list) -> DataFrame:
    """Every event as one situation of a decision table: consecutive events go through all combinations."""
    own, rest = dealt(values)
    rows = read(spark, sf, "events").select(*[F.element_at(F.array(*[F.lit(o) for o in options]), (F.expr(f"event_id div {stride}") % len(options) + 1).cast("int")).alias(name) for name, options, stride in own])
    for name, options in rest:
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return rows


def literal(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


def cross(**values: list) -> str:
    """The same rows in SQL."""
    own, rest = dealt(values)
    columns = ", ".join(f"[{', '.join(map(literal, options))}][(event_id // {stride}) % {len(options)} + 1] AS {name}" for name, options, stride in own)
    more = [f"(VALUES {', '.join(f'({literal(o)})' for o in options)}) AS t_{name}({name})" for name, options in rest]
    return " CROSS JOIN ".join([f"(SELECT {columns} FROM events) AS t_events", *more])


STATES = ["absent", "held", "committed", "consumed", "released", "expired", "rejected", "cancelled"]
COMMANDS = "query confirm cancel expire hold-enough hold-short hold-same hold-other consume-within consume-exact consume-beyond consume-used-same consume-used-other".split()
RESERVE = {"s": STATES, "past": [True, False], "c": COMMANDS}


@registered(
    f"""WITH g AS (SELECT * FROM {cross(**RESERVE)}), m AS (SELECT *,
 CASE WHEN c = 'hold-enough' AND s = 'absent' THEN 'held/take' WHEN c = 'hold-short' AND s = 'absent' THEN 'rejected/none' WHEN c IN ('confirm', 'expire') AND s = 'held' AND past THEN 'expired/give_back'
  WHEN c = 'confirm' AND s = 'held' THEN 'committed/none' WHEN c = 'cancel' AND s = 'absent' THEN 'cancelled/none' WHEN c = 'cancel' AND s IN ('held', 'committed') THEN 'released/give_back'
  WHEN c = 'consume-exact' AND s = 'committed' THEN 'consumed/consume' WHEN c = 'consume-within' AND s = 'committed' THEN 'committed/consume' END AS move FROM g)
SELECT s, past, c, coalesce(split_part(move, '/', 1), s) AS state, c = 'consume-used-other' OR (c = 'hold-other' AND s <> 'cancelled') AS conflict,
 CASE WHEN c IN ('consume-within', 'consume-exact', 'consume-beyond') THEN CASE WHEN s = 'absent' THEN 'absent' WHEN s <> 'committed' THEN 'not_committed' WHEN c = 'consume-beyond' THEN 'beyond_remaining' END END AS refused,
 coalesce(split_part(move, '/', 2), 'none') AS resource, move IS NOT NULL AS changed FROM m"""
)
def table_reservation(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid(spark, sf, **RESERVE)
    return rows.select("*", d.reservation(F.col("s"), F.col("past"), F.col("c")).alias("o")).select("s", "past", "c", "o.*")


ROWS = {"state": [None, "complete", "incomplete", "tombstone"], "version": [3], "old": [True, False], "kind": ["full", "partial", "delete", "purged"], "v": [2, 3, 4]}


@registered(
    f"""WITH g AS (SELECT * FROM {cross(**ROWS)} WHERE NOT (state IS NULL AND old)),
t AS (SELECT *, CASE kind WHEN 'full' THEN 'complete' WHEN 'partial' THEN 'incomplete' ELSE 'tombstone' END AS target FROM g),
a AS (SELECT *, CASE WHEN kind = 'purged' THEN 'write' WHEN state IS NULL THEN CASE kind WHEN 'partial' THEN 'write_and_fetch' ELSE 'write' END WHEN old THEN CASE kind WHEN 'partial' THEN 'write_and_fetch' ELSE 'overwrite' END
 WHEN state = 'tombstone' AND v > version THEN CASE kind WHEN 'partial' THEN 'write_and_fetch' WHEN 'full' THEN 'overwrite' ELSE 'write' END WHEN state = 'tombstone' THEN 'ignore'
 WHEN kind = 'full' AND (v > version OR (state = 'incomplete' AND v >= version)) THEN 'overwrite' WHEN kind = 'partial' AND v > version THEN 'merge_and_fetch' WHEN kind = 'delete' AND v >= version THEN 'write' ELSE 'ignore' END AS action FROM t)
SELECT state AS before, old, kind, CAST(v AS BIGINT) AS v, CASE WHEN action = 'ignore' THEN state ELSE target END AS after, CAST(CASE WHEN kind = 'purged' THEN 0 WHEN action = 'ignore' THEN version ELSE v END AS BIGINT) AS version, action FROM a"""
)
def table_projection_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid(spark, sf, **ROWS).where("NOT (state IS NULL AND old)").withColumn("version", F.when(F.col("state").isNotNull(), F.col("version").cast("long"))).withColumn("v", F.col("v").cast("long"))
    need = F.when(F.col("state") == "incomplete", F.col("version"))
    out = d.projection_row(F.col("state"), F.col("version"), need, F.col("old"), F.col("kind"), F.col("v"))
    return rows.withColumn("o", out).select(F.col("state").alias("before"), "old", "kind", "v", F.col("o.state").alias("after"), F.col("o.version").alias("version"), F.col("o.action").alias("action"))


IDENTITY = {"dep": ["d1", "d2"], "own": ["", "i1"], "impl": ["i1", "i2"], "sys": ["s1", "s2"], "epoch": ["1.9", "2.3", "2.4", "3.0"], "prim": [True, False], "purpose": ["", "align"]}


@registered(
    f"""SELECT dep, own, impl, sys, epoch, prim, purpose, CASE WHEN dep <> 'd1' THEN 'block' WHEN own = '' THEN CASE WHEN prim THEN 'establish' ELSE 'discard' END WHEN impl <> 'i1' THEN 'block'
 WHEN NOT prim THEN CASE WHEN sys = 's1' AND epoch = '2.3' AND purpose = '' THEN 'use' ELSE 'discard' END WHEN sys <> 's1' AND epoch IN ('1.9', '2.3', '2.4') THEN 'stall'
 WHEN epoch IN ('2.4', '3.0') THEN 'adopt' WHEN epoch = '1.9' THEN 'ignore' ELSE 'use' END AS decision FROM {cross(**IDENTITY)}"""
)
def table_source_identity(spark: SparkSession, sf: str) -> DataFrame:
    adopted = F.struct(F.lit("d1").alias("deployment"), F.col("own").alias("impl"), F.lit("s1").alias("system"), F.lit("2.3").alias("epoch"))
    told = F.struct(F.col("dep").alias("deployment"), "impl", F.col("sys").alias("system"), "epoch", F.col("prim").alias("primary"), "purpose")
    return grid(spark, sf, **IDENTITY).withColumn("decision", d.source_identity(adopted, told))


PULLS = {"requested": [0, 5], "unreachable": [True, False], "need": ["", "beyond_retention", "rollback_detected"], "echo": [4, 5, 6]}


@registered(
    f"""SELECT requested, unreachable, need, echo, CASE WHEN unreachable THEN 'hold' WHEN need = 'beyond_retention' THEN 'realign' WHEN need <> '' OR (requested > 0 AND echo < requested) THEN 'stall' ELSE 'apply_to_echo' END AS outcome FROM {cross(**PULLS)}"""
)
def table_pull_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf, **PULLS).withColumn("outcome", d.pull_outcome(*[F.col(c) for c in PULLS]))


CHECKS = {"asked": [False, True], "impl": ["i1", "i2"], "epoch": ["1.0", "2.0"], "seq": [7, 9], "there": ["none", "same", "other"]}


@registered(
    f"""SELECT asked, impl, epoch, seq, there, CASE WHEN NOT asked OR impl <> 'i1' OR epoch <> '2.0' THEN 'echo_only' WHEN seq > 8 THEN 'rollback_detected' WHEN there = 'none' THEN 'beyond_retention' WHEN there = 'other' THEN 'rollback_detected' ELSE 'ok' END AS outcome FROM {cross(**CHECKS)}"""
)
def table_pull_check(spark: SparkSession, sf: str) -> DataFrame:
    def row(digest: str) -> Column:
        return F.struct(F.lit("r1").alias("record_id"), F.lit(3).alias("version"), F.lit(digest).alias("digest"))

    asked = F.when(F.col("asked"), F.struct("impl", "epoch", "seq"))
    found = F.when(F.col("there") == "same", row("a")).when(F.col("there") == "other", row("b"))
    return grid(spark, sf, **CHECKS).withColumn("outcome", d.pull_check(F.lit("i1"), F.lit("2.0"), F.lit(8), asked, row("a"), found))


EVENTS = "claim before_send lease_lost send_result query_found query_not_found query_unavailable finality_passed registered".split()
COMMAND = {
    "s": "prepared retry_wait sending unknown accepted manual succeeded".split(), "e": EVENTS, "r": ["not_reached", "maybe_reached", "accepted", "succeeded", "rejected", "processing"],
    "past": [True, False], "abandon": ["none", "later", "over"], "long_ago": [True, False], "lands": [True, False], "q": [True, False],
}


@registered(
    f"""WITH g AS (SELECT * FROM {cross(**COMMAND)}) SELECT s, e, r, past, abandon, long_ago, lands, q, CASE
 WHEN s = 'succeeded' THEN s WHEN abandon = 'over' AND s IN ('prepared', 'retry_wait', 'unknown') THEN 'failed'
 WHEN e = 'claim' AND s IN ('prepared', 'retry_wait') THEN CASE WHEN past THEN 'unknown' ELSE 'sending' END
 WHEN e = 'before_send' AND s = 'sending' THEN CASE WHEN past THEN 'unknown' ELSE 'sending' END WHEN e = 'lease_lost' AND s = 'sending' THEN 'unknown'
 WHEN e = 'send_result' AND s = 'sending' THEN CASE r WHEN 'not_reached' THEN 'retry_wait' WHEN 'maybe_reached' THEN 'unknown' WHEN 'processing' THEN s ELSE r END
 WHEN e = 'query_found' AND s IN ('unknown', 'accepted') THEN CASE WHEN r IN ('accepted', 'succeeded', 'rejected') THEN r ELSE s END
 WHEN e = 'query_unavailable' AND s IN ('unknown', 'accepted') THEN CASE WHEN long_ago AND NOT (s = 'unknown' AND abandon = 'later') THEN 'manual' ELSE s END
 WHEN e = 'query_not_found' AND s = 'unknown' THEN CASE WHEN NOT lands THEN 'sending' WHEN abandon = 'later' THEN s ELSE 'manual' END
 WHEN e = 'finality_passed' AND s = 'accepted' THEN CASE WHEN NOT q AND long_ago THEN 'manual' ELSE 'accepted' END
 WHEN e = 'registered' AND s = 'manual' THEN r ELSE s END AS state FROM g"""
)
def table_external_command(spark: SparkSession, sf: str) -> DataFrame:
    now, long = 1_000_000.0, "double"
    none = F.lit(None).cast(long)
    since = F.when(F.col("long_ago"), now - 100_000).otherwise(now - 60)
    facts = {
        "state": F.col("s"), "deadline": F.when(F.col("past"), now - 1).otherwise(now + 1), "expires": none, "first": F.lit(now - 50_000), "last": F.lit(now - 50_000), "unknown_since": since, "accepted_since": since, "unrecorded": none,
        "abandon": F.when(F.col("abandon") == "later", now + 10).when(F.col("abandon") == "over", now - 10),
    }
    offers = {"dedupe_s": F.lit(0.0), "last_use": F.lit(True), "query": F.col("q"), "processing_s": F.when(F.col("lands"), 90_000.0).otherwise(40_000.0)}
    rows = grid(spark, sf, **COMMAND)
    return rows.withColumn("state", d.external_command(facts, F.col("e"), F.col("r"), offers, F.lit(now))["state"])


APPROVAL = {
    "task": ["pending", "decided"], "instance": ["running", "withdrawn"], "ver": [True, False], "own": [True, False], "cand": [True, False], "op": [True, False], "qual": ["qualified", "not_qualified", "unknown"],
    "rev": [True, False], "replay": [True, False], "choice": ["approve", "reject"], "others": [True, False], "last": [True, False],
}


@registered(
    f"""WITH r AS (SELECT *, CASE WHEN task <> 'pending' OR instance <> 'running' THEN 'TASK_NOT_PENDING' WHEN NOT ver THEN 'VERSION_CONFLICT' WHEN own THEN 'SELF_APPROVAL' WHEN NOT cand THEN 'NOT_ASSIGNEE' WHEN NOT op THEN 'PERMISSION_DENIED'
 WHEN qual = 'not_qualified' THEN 'NOT_QUALIFIED' WHEN qual = 'unknown' THEN 'QUALIFICATION_UNKNOWN' WHEN NOT rev THEN 'REVISION_CHANGED' END AS why FROM {cross(**APPROVAL)})
SELECT task, instance, ver, own, cand, op, qual, rev, replay, choice, others, last, CASE WHEN NOT replay THEN why END AS refused, CASE WHEN replay OR why IS NOT NULL THEN task ELSE 'decided' END AS task_after,
 CASE WHEN replay OR why IS NOT NULL THEN instance WHEN choice = 'reject' THEN 'returned' WHEN last THEN 'approved' ELSE 'running' END AS instance_after, NOT replay AND why IS NULL AND choice <> 'reject' AND NOT last AS next_step FROM r"""
)
def table_approval(spark: SparkSession, sf: str) -> DataFrame:
    names = {"task": "task", "instance": "instance", "version_matches": "ver", "self": "own", "candidate": "cand", "operation": "op", "qualification": "qual", "revision_matches": "rev", "replay": "replay"}
    out = d.approval({k: F.col(v) for k, v in names.items()}, F.col("choice"), F.col("others"), F.col("last"), F.lit("returned"))
    return grid(spark, sf, **APPROVAL).withColumn("o", out).select(*APPROVAL, "o.refused", F.col("o.task").alias("task_after"), F.col("o.instance").alias("instance_after"), "o.next_step")


ARRIVAL = {
    "shape_ok": [True, False], "audience_is_self": [True, False], "stream_is_source": [True, False], "grant_exists": [True, False], "principal_matches": [True, False], "action_allowed": [True, False],
    "prior": ["", "same_action", "other_action"], "clicked_in_time": [True, False], "processed_in_time": [True, False], "security_version_newer": [True, False], "decision": ["approved", "DATABASE_ERROR", "VERSION_CONFLICT"],
}


@registered(
    f"""WITH a AS (SELECT *, CASE WHEN NOT shape_ok THEN 'malformed' WHEN NOT audience_is_self THEN '-' WHEN NOT stream_is_source THEN 'not_the_sender' WHEN NOT grant_exists THEN 'unknown_grant' WHEN NOT principal_matches THEN 'not_the_holder' WHEN NOT action_allowed THEN 'action_not_allowed'
 WHEN prior = 'same_action' THEN '=' WHEN prior = 'other_action' THEN 'GRANT_USED' WHEN NOT clicked_in_time OR NOT processed_in_time THEN 'expired' WHEN security_version_newer THEN 'GRANT_STALE' WHEN decision = 'approved' THEN '+' ELSE decision END AS w FROM {cross(**ARRIVAL)})
SELECT shape_ok, audience_is_self, stream_is_source, grant_exists, principal_matches, action_allowed, prior, clicked_in_time, processed_in_time, security_version_newer, decision,
 CASE w WHEN '-' THEN 'ignored' WHEN '=' THEN 'replayed' WHEN '+' THEN 'executed' WHEN 'DATABASE_ERROR' THEN 'retry' ELSE 'refused' END AS answer, CASE WHEN w NOT IN ('-', '=', '+') THEN w END AS reason,
 w NOT IN ('-', '=', '+', 'DATABASE_ERROR') AS audit, w IN ('+', 'expired', 'GRANT_STALE', 'VERSION_CONFLICT') AS record FROM a"""
)
def table_arriving_action(spark: SparkSession, sf: str) -> DataFrame:
    out = d.arriving_action({name: F.col(name) for name in ARRIVAL})
    return grid(spark, sf, **ARRIVAL).withColumn("o", out).select(*ARRIVAL, "o.answer", "o.reason", "o.audit", "o.record")


WORK = {"kind": ["wait", "permanent", "not_effective", "transient"], "attempts": [1, 3, 5], "effect": ["idempotent", "non_idempotent_external"], "unsure": [True, False], "waited": [0.0, 40.0, 4000.0], "most_wait": [0.0, 1000.0]}


@registered(
    f"""SELECT kind, attempts, effect, unsure, CAST(waited AS DOUBLE) AS waited, CAST(most_wait AS DOUBLE) AS most_wait, CASE WHEN kind = 'wait' AND most_wait > 0 AND waited > most_wait THEN 'dead' WHEN kind = 'wait' THEN 'retry_wait' WHEN kind = 'permanent' THEN 'dead'
 WHEN effect = 'non_idempotent_external' AND kind <> 'not_effective' AND unsure THEN 'paused' WHEN attempts >= 5 THEN 'dead' ELSE 'retry_wait' END AS state,
 CAST(CASE WHEN kind = 'wait' AND NOT (most_wait > 0 AND waited > most_wait) THEN least(300, greatest(1, waited)) WHEN kind IN ('not_effective', 'transient') AND NOT (effect = 'non_idempotent_external' AND kind <> 'not_effective' AND unsure) AND attempts < 5 THEN least(300, pow(2, attempts - 1)) END AS DOUBLE) AS wait_s FROM {cross(**WORK)}"""
)
def table_work_failure(spark: SparkSession, sf: str) -> DataFrame:
    out = d.work_failure(F.col("kind"), F.col("attempts"), F.lit(5), F.col("effect"), F.col("unsure"), F.col("waited"), F.col("most_wait"))
    return grid(spark, sf, **WORK).withColumn("o", out).select(*WORK, "o.state", "o.wait_s")


KINDS = ["first_contact", "alignment_done", "adopt_epoch", "rollback", "foreign", "operator_confirms", "primary_response", "beyond_retention", "environment_copy"]


@registered(
    """WITH RECURSIVE e AS (SELECT user_id AS source, ['"""
    + "', '".join(KINDS)
    + """'][event_id * 7919 % 1009 % 9 + 1] AS kind, event_id // 500 AS gen, event_id % 4 <> 0 AS matches, event_id % 3 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT source, CAST(0 AS BIGINT) AS n, 'aligning' AS state, 'none' AS action, false AS confirmed, false AS rollback, CAST(NULL AS BIGINT) AS stalled_gen, CAST(NULL AS VARCHAR) AS prior FROM (SELECT DISTINCT source FROM e)
  UNION ALL SELECT source, n,
    CASE b WHEN 'copy' THEN 'aligning' WHEN 'block' THEN 'blocked' WHEN 'still_behind' THEN 'stalled' WHEN 'row_failed' THEN 'stalled' WHEN 'opened' THEN 'aligning' WHEN 'rollback' THEN 'stalled' WHEN 'adopt_stalled' THEN 'aligning' WHEN 'refetch' THEN 'aligning' WHEN 'behind' THEN 'stalled' WHEN 'done' THEN 'aligned' ELSE state END,
    CASE b WHEN 'copy' THEN 'clear_and_refetch' WHEN 'block' THEN 'alert_and_hold' WHEN 'confirm' THEN 'record_confirmation' WHEN 'hold' THEN 'hold' WHEN 'still_behind' THEN 'refetch' WHEN 'row_failed' THEN 'refetch' WHEN 'opened' THEN 'row_check_then_refetch' WHEN 'rollback' THEN 'refetch'
      WHEN 'adopt_stalled' THEN 'refetch' WHEN 'keep' THEN 'keep_refetching' WHEN 'refetch' THEN 'refetch' WHEN 'done' THEN 'watermark_from_echoes' ELSE 'alert' END,
    CASE WHEN b = 'confirm' THEN true WHEN b IN ('copy', 'mismatch', 'still_behind', 'row_failed', 'opened') THEN false ELSE confirmed END,
    CASE WHEN b IN ('row_failed', 'rollback') THEN true WHEN b IN ('copy', 'done') THEN false ELSE rollback END, CASE WHEN b IN ('row_failed', 'rollback') THEN gen ELSE stalled_gen END, CASE WHEN b = 'block' THEN state ELSE prior END
  FROM (SELECT e.source, e.n, e.gen, r.state, confirmed, rollback, stalled_gen, prior, CASE WHEN kind = 'environment_copy' THEN 'copy' WHEN kind = 'foreign' THEN CASE WHEN r.state = 'blocked' THEN 'alert' ELSE 'block' END
    WHEN r.state = 'blocked' THEN CASE WHEN kind = 'operator_confirms' THEN 'confirm' WHEN kind <> 'primary_response' OR NOT confirmed THEN 'hold' WHEN NOT matches THEN 'mismatch' WHEN prior = 'stalled' AND gen <= coalesce(stalled_gen, -1) THEN 'still_behind' WHEN failed THEN 'row_failed' ELSE 'opened' END
    WHEN kind = 'rollback' THEN 'rollback' WHEN r.state = 'stalled' THEN CASE WHEN kind = 'adopt_epoch' AND gen > coalesce(stalled_gen, -1) THEN 'adopt_stalled' ELSE 'keep' END WHEN kind IN ('adopt_epoch', 'first_contact', 'beyond_retention') THEN 'refetch'
    WHEN r.state = 'aligning' AND kind = 'alignment_done' THEN CASE WHEN rollback AND gen <= coalesce(stalled_gen, -1) THEN 'behind' ELSE 'done' END ELSE 'alert' END AS b FROM r JOIN e ON e.source = r.source AND e.n = r.n + 1))
SELECT source, state, action, rollback FROM (SELECT *, max(n) OVER (PARTITION BY source) AS m FROM r) WHERE n = m"""
)
def table_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """State of every source after its log of events, folded in order."""
    e, n = read(spark, sf, "events"), F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (n * 7919 % 1009 % len(KINDS) + 1).cast("int"))
    log = e.select(F.col("user_id").alias("source"), n.alias("seq"), kind.alias("kind"), F.expr("event_id div 500").alias("gen"), (n % 4 != 0).alias("matches"), F.when(n % 3 == 0, "failed").otherwise("passed").alias("row_check"))
    return d.alignment_states(log, ["seq"]).select("source", "state", "action", "rollback")
