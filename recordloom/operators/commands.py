"""Work items, reservations, external commands and approvals over their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.decisions import external_command, resend_deadline, reservation


def claimable(items: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next items to run: those whose lease is over first, then by due time; a top-n of one batch."""
    expired = (F.col("state") == "running") & (F.col("lease_until") < now)
    due = F.col("state").isin("pending", "retry_wait") & (F.col("run_at") <= now)
    order = [F.when(expired, 0).otherwise(1), F.when(expired, F.col("lease_until")).otherwise(F.col("run_at")), F.col("id")]
    return items.where(expired | due).orderBy(*order).limit(limit)


def purgeable(items: DataFrame, cron_watermarks: DataFrame, now: Column, done_days: int = 7, dead_days: int = 30) -> DataFrame:
    """Finished items past their retention; slots of a time table only behind its watermark (job, watermark_at)."""
    age = F.when(F.col("state") == "dead", F.lit(dead_days)).otherwise(F.lit(done_days))
    old = F.col("state").isin("succeeded", "dead") & (F.col("finished_at") < now - F.make_dt_interval(age))
    told = items.where(old).join(cron_watermarks, "job", "left")
    return told.where(F.col("slot_at").isNull() | (F.col("slot_at") <= F.col("watermark_at"))).drop("watermark_at")


def reservation_states(commands: DataFrame, order: list[str]) -> DataFrame:
    """``branch, state, changes``: every branch after its commands in order, folded in one aggregation.

    ``commands``: branch, command, past, and the order's columns. A branch's commands are a bounded list.
    """
    log = F.transform(F.array_sort(F.collect_list(F.struct(*order, "command", "past"))), lambda c: F.struct(c["command"].alias("command"), c["past"].alias("past")))
    start = F.struct(F.lit("absent").alias("state"), F.lit(0).alias("changes"))

    def step(now: Column, c: Column) -> Column:
        out = reservation(now["state"], c["past"], c["command"])
        return F.struct(out["state"].alias("state"), (now["changes"] + out["changed"].cast("int")).alias("changes"))

    return commands.groupBy("branch").agg(F.aggregate(log, start, step).alias("o")).select("branch", "o.state", "o.changes")


def command_states(log: DataFrame, order: list[str]) -> DataFrame:
    """``command, state, why, steps``: every external command after the events of its log in order, folded in one aggregation.

    ``log``: command, event, result, at (unix seconds), and per command the same dedupe_s, last_use, query,
    processing_s, abandon (unix second or null). Times that later rules read (when a send may first and last have
    reached the other side, since when the state is unknown or accepted) are kept along the way.
    """
    wide = ["event", "result", "at", "dedupe_s", "last_use", "query", "processing_s", "abandon"]
    events = F.array_sort(F.collect_list(F.struct(*order, *[c for c in wide if c not in order])))
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit("prepared").alias("state"), F.lit("").alias("why"), none.alias("first"), none.alias("last"), none.alias("unknown_since"), none.alias("accepted_since"), F.lit(0).alias("steps"),
    )

    def step(now: Column, e: Column) -> Column:
        at = e["at"].cast("double")
        deadline = resend_deadline(now["first"], now["last"], e["dedupe_s"], e["last_use"])
        facts = {name: now[name] for name in ("state", "first", "last", "unknown_since", "accepted_since")} | {"deadline": deadline, "expires": none, "unrecorded": none, "abandon": e["abandon"].cast("double")}
        out = external_command(facts, e["event"], e["result"], {name: e[name] for name in ("dedupe_s", "last_use", "query", "processing_s")}, at)
        reached = ((e["event"] == "send_result") & ~e["result"].eqNullSafe(F.lit("not_reached"))) | (e["event"] == "lease_lost")
        reached = F.coalesce(reached & (now["state"] == "sending"), F.lit(False))

        def since(name: str, kept: Column) -> Column:
            return F.when(out["state"] != name, none).otherwise(F.when(now["state"] == name, kept).otherwise(at))

        return F.struct(
            out["state"].alias("state"), out["why"].alias("why"), F.when(reached, F.coalesce(now["first"], at)).otherwise(now["first"]).alias("first"), F.when(reached, at).otherwise(now["last"]).alias("last"),
            since("unknown", now["unknown_since"]).alias("unknown_since"), since("accepted", now["accepted_since"]).alias("accepted_since"), (now["steps"] + 1).alias("steps"),
        )

    return log.groupBy("command").agg(F.aggregate(events, start, step).alias("o")).select("command", "o.state", "o.why", "o.steps")


def instance_states(decisions: DataFrame, order: list[str]) -> DataFrame:
    """``instance, state, step``: approval instances after their decisions in order. Every step takes one decision; a
    rejection ends the instance as it says (``on_reject``), the last of ``steps`` approvals approves it; decisions on
    an instance that has ended, or on a step that is not the current one, change nothing.

    ``decisions``: instance, step (from 1), choice, steps, on_reject, and the order's columns.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, *[c for c in ("step", "choice", "steps", "on_reject") if c not in order])))
    start = F.struct(F.lit("running").alias("state"), F.lit(1).alias("step"))

    def step(now: Column, d: Column) -> Column:
        counts = (now["state"] == "running") & (d["step"] == now["step"])
        state = F.when(counts & (d["choice"] == "reject"), d["on_reject"]).when(counts & (d["step"] == d["steps"]), "approved").otherwise(now["state"])
        next_ = F.when(counts & (d["choice"] == "approve") & (d["step"] < d["steps"]), now["step"] + 1).otherwise(now["step"])
        return F.struct(state.alias("state"), next_.alias("step"))

    return decisions.groupBy("instance").agg(F.aggregate(log, start, step).alias("o")).select("instance", "o.state", "o.step")


def unfinished_sends(commands: DataFrame, attempts: DataFrame) -> DataFrame:
    """``commands`` with ``sending_at``: the earliest start of a send attempt that has not ended."""
    starts = attempts.where("kind = 'send' AND ended_at IS NULL").groupBy("command").agg(F.min("started_at").alias("sending_at"))
    return commands.join(starts, "command", "left")


def first_requests(requests: DataFrame, order: list[str]) -> DataFrame:
    """``requests`` with ``outcome``: the first of a (requester, reference) is new, equal parameters repeat it, others conflict."""
    by = Window.partitionBy("requester", "reference").orderBy(*order)
    first = F.first("digest").over(by)
    return requests.withColumn("outcome", F.when(F.row_number().over(by) == 1, "new").when(F.col("digest") == first, "repeat").otherwise("conflict"))


def decision_of(tasks: DataFrame, decisions: DataFrame, account: Column) -> DataFrame:
    """``document, task, rank``: the task whose decision a person sees for each document: their own decision, a task
    that waits for them, one they are a candidate of, then any; the newest of its kind.

    ``tasks``: document, task, state, created_at, candidates (array); ``decisions``: task, decided_by.
    """
    own = decisions.where(F.col("decided_by") == account).select("task", F.lit(True).alias("mine")).distinct()
    told = tasks.join(own, "task", "left")
    candidate = F.array_contains("candidates", account)
    rank = F.when(F.col("mine"), 0).when((F.col("state") == "pending") & candidate, 1).when(candidate, 2).otherwise(3)
    ranked = told.withColumn("rank", rank)
    best = ranked.groupBy("document").agg(F.min_by(F.struct("task", "rank"), F.struct("rank", -F.unix_micros("created_at"), "task")).alias("b"))
    return best.select("document", "b.task", "b.rank")


def candidates_of(tasks: DataFrame, holders: DataFrame, persons: DataFrame) -> DataFrame:
    """``task, account``: holders of a task's position, without any account of the initiator's person.

    ``tasks``: task, position columns, initiator; ``holders``: the same columns, account; ``persons``: account, person.
    Tasks meet each account of their position once, however often it holds it; so only tasks of several positions can give a
    pair twice.
    """
    keys = [c for c in holders.columns if c != "account"]
    person = F.coalesce("person", "account")
    known = persons.groupBy("account").agg(F.min(person).alias("_low"), F.max(person).alias("_high"))

    def told(rows: DataFrame, account: str) -> DataFrame:
        """The first and the last of the account's persons; it is its own person if it has none."""
        return rows.join(known.withColumnRenamed("account", account), account, "left").withColumns({c: F.coalesce(c, account) for c in ("_low", "_high")})

    held = told(holders.distinct(), "account").withColumnsRenamed({"_low": "_least", "_high": "_most"})
    asked = told(tasks.select("task", *keys, "initiator"), "initiator").repartition("task").groupBy("task", *keys).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    asked = asked.withColumn("_positions", F.count("*").over(Window.partitionBy("task")))
    other = (F.col("_least") != F.col("_high")) | (F.col("_most") != F.col("_low"))  # some person of one side is not one of the other's

    def pairs(some: DataFrame) -> DataFrame:
        return some.join(held, keys).where(other).select("task", "account")

    return pairs(asked.where("_positions = 1")).unionByName(pairs(asked.where("_positions > 1")).distinct())


def collapsed(intents: DataFrame, now: Column) -> DataFrame:
    """The latest intent of each collapse key that has not expired; intents without a key stay as they are."""
    live = intents.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    keyed = live.where("collapse_key IS NOT NULL")
    rest = [c for c in intents.columns if c != "collapse_key"]
    top = keyed.groupBy("collapse_key").agg(F.max_by(F.struct(*rest), F.struct("sequence", "id")).alias("t")).select("collapse_key", "t.*")
    return top.select(*intents.columns).unionByName(live.where("collapse_key IS NULL"))


def operated(items: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Work items after an operator's commands (id, command: requeue, resolve or hold; verified; reason), with ``refused``.

    ``items``: id, state, pause_reason, attempts, outcome_unknown, result, run_at, finished_at. A dead item without an unknown
    outcome and one paused for its backlog or for business go back; one paused on an unknown outcome only if the operator
    verified that it had no effect. Dead and paused items can be resolved, pending and waiting ones held.
    """
    told = items.join(asked.select("id", "command", "verified", "reason"), "id", "left")
    state, why, command = F.col("state"), F.col("pause_reason"), F.col("command")
    freed = ((state == "dead") & ~F.col("outcome_unknown")) | ((state == "paused") & why.isin("backlog_exceeded", "business_hold")) | ((state == "paused") & (why == "outcome_unknown") & F.col("verified"))
    new = F.when((command == "requeue") & freed, "pending").when((command == "resolve") & state.isin("dead", "paused"), "resolved").when((command == "hold") & state.isin("pending", "retry_wait"), "paused")
    told = told.withColumn("_new", new)
    requeued, resolved, held = F.col("_new") == "pending", F.col("_new") == "resolved", F.col("_new") == "paused"
    return told.select(
        "id", F.coalesce("_new", state).alias("state"), F.when(held, "business_hold").when(F.col("_new").isNull(), why).alias("pause_reason"), F.when(requeued, 0).otherwise(F.col("attempts")).alias("attempts"),
        (F.col("outcome_unknown") & ~F.coalesce(requeued, F.lit(False))).alias("outcome_unknown"), F.when(resolved, F.col("reason")).otherwise(F.col("result")).alias("result"), F.when(requeued, now).otherwise(F.col("run_at")).alias("run_at"),
        F.when(resolved, now).otherwise(F.col("finished_at")).alias("finished_at"), (command.isNotNull() & F.col("_new").isNull()).alias("refused"),
    )


def run_progress(log: DataFrame) -> DataFrame:
    """``run, segment, progress, calls, outcome_unknown`` after each run's log (run, at, kind: before_call, call or checkpoint; name, value).

    A checkpoint commits its progress and starts a new segment, whose call results begin empty; of a call the latest
    result counts; a call that may have been sent leaves the outcome unknown until a result other than 'unknown' comes.
    """
    last = log.where("kind = 'checkpoint'").groupBy("run").agg(F.count("*").alias("segment"), F.max_by("value", "at").alias("progress"), F.max("at").alias("_since"))
    own = log.join(last.select("run", "_since"), "run", "left").where("kind = 'call' AND (_since IS NULL OR at > _since)")
    newest = own.groupBy("run", "name").agg(F.max_by("value", "at").alias("value")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("calls"))
    sent = log.where("kind = 'before_call' OR (kind = 'call' AND value <> 'unknown')").groupBy("run").agg((F.max_by("kind", "at") == "before_call").alias("outcome_unknown"))
    every = log.select("run").distinct().join(last.drop("_since"), "run", "left").join(newest, "run", "left").join(sent, "run", "left")
    none = F.create_map().cast("map<string,string>")
    return every.select("run", F.coalesce("segment", F.lit(0).cast("long")).alias("segment"), "progress", F.coalesce("calls", none).alias("calls"), F.coalesce("outcome_unknown", F.lit(False)).alias("outcome_unknown"))
