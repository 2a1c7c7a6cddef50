"""Decision tables as columns: one ordered chain of conditions each, first matching rule wins.

Inputs are columns, outputs columns or structs of columns, so a table is decided for any number of rows at once
within code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.keys import epoch_of

DAY, HOUR = 86_400, 3_600


def first_of(*rules: tuple[Column, Column | str], otherwise: Column | str) -> Column:
    """Value of the first rule whose condition is true (null counts as false)."""
    chain = None
    for condition, value in rules:
        result = F.lit(value) if isinstance(value, str) else value
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def projection_row(state: Column, version: Column, need: Column, old: Column, kind: Column, v: Column) -> Column:
    """struct(state, version, need_version, action) after an input; ``state`` is null without a row.

    An older instance's or epoch's row (``old``) gives way whatever its version; a tombstone is revived by newer
    versions only; a partial input leaves the row waiting for a fetch.
    """

    def row(name: Column, number: Column, action: Column) -> Column:
        wanted = F.when(name == "incomplete", number)
        return F.struct(name.alias("state"), number.alias("version"), wanted.alias("need_version"), action.alias("action"))

    target = F.when(kind == "full", "complete").when(kind == "partial", "incomplete").otherwise("tombstone")
    fresh = F.when(kind == "partial", "write_and_fetch")
    stay = F.struct(state.alias("state"), version.alias("version"), need.alias("need_version"), F.lit("ignore").alias("action"))
    newer = v > version
    complete = (kind == "full") & (((state == "complete") & newer) | ((state == "incomplete") & (v >= need)))
    return first_of(
        (kind == "purged", row(F.lit("tombstone"), F.lit(0).cast("long"), F.lit("write"))),
        (state.isNull(), row(target, v, F.coalesce(fresh, F.lit("write")))),
        (old, row(target, v, F.coalesce(fresh, F.lit("overwrite")))),
        ((state == "tombstone") & newer, row(target, v, F.coalesce(fresh, F.when(kind == "full", "overwrite"), F.lit("write")))),
        (state == "tombstone", stay),
        (complete, row(F.lit("complete"), v, F.lit("overwrite"))),
        ((kind == "partial") & newer, row(F.lit("incomplete"), v, F.lit("merge_and_fetch"))),
        ((kind == "delete") & (v >= version), row(F.lit("tombstone"), v, F.lit("write"))),
        otherwise=stay,
    )


def source_identity(adopted: Column, told: Column) -> Column:
    """What a declared source identity means; structs (deployment, impl, system, epoch[, primary, purpose])."""
    ours, theirs = epoch_of(adopted["epoch"]), epoch_of(told["epoch"])
    same = (told["system"] == adopted["system"]) & (told["epoch"] == adopted["epoch"]) & ~told["purpose"].isin("adopt", "align")
    return first_of(
        (told["deployment"] != adopted["deployment"], "block"),
        ((adopted["impl"] == "") & told["primary"], "establish"),
        (adopted["impl"] == "", "discard"),
        (told["impl"] != adopted["impl"], "block"),
        (~told["primary"] & same, "use"),
        (~told["primary"], "discard"),
        ((told["system"] != adopted["system"]) & (theirs["generation"] <= ours["generation"]), "stall"),
        (theirs > ours, "adopt"),
        (theirs < ours, "ignore"),
        otherwise="use",
    )


def pull_outcome(requested: Column, unreachable: Column, need: Column, echo: Column) -> Column:
    return first_of(
        (unreachable, "hold"),
        (need == "beyond_retention", "realign"),
        (need == "rollback_detected", "stall"),
        ((requested > 0) & (echo < requested), "stall"),
        otherwise="apply_to_echo",
    )


def pull_check(impl: Column, epoch: Column, counter: Column, asked: Column, wanted: Column, found: Column) -> Column:
    """Whether a pull may go on from the consumer's position: struct ``asked`` (impl, epoch, seq; null: echo only),
    the row it names and the row there (null: not there)."""
    other = asked.isNull() | (asked["impl"] != impl) | (asked["epoch"] != epoch)
    return first_of(
        (other, "echo_only"),
        (asked["seq"] > counter, "rollback_detected"),
        (found.isNull(), "beyond_retention"),
        (~found.eqNullSafe(wanted), "rollback_detected"),
        otherwise="ok",
    )


def clock_reset(now: Column, largest_seen: Column, epoch: Column, recorded_epoch: Column) -> Column:
    return (now < largest_seen) | (epoch != recorded_epoch)


def archive_plan(now: Column, least_range_s: Column, grace_s: Column, unit: dict[str, Column]) -> Column:
    """struct(action, reasons, alert): what happens to an archive unit next, or every reason that holds it back.

    ``unit``: category, residence_days (null: never), retention_pending, erasable, state, anchor_max, blockers,
    immutable_route, published_at, newest_created, old_leases, backed_up, retention_due, approved, holds.
    """
    seconds = F.unix_timestamp
    residence = unit["residence_days"] * DAY
    due = seconds(unit["anchor_max"]) + residence
    text = "array<string>"
    nothing = F.array().cast(text)

    def decided(action: str, reasons: Column = nothing, alert: Column | None = None) -> Column:
        kept = F.array_sort(reasons)
        name = F.when(F.size(kept) == 0, action).otherwise("none")
        return F.struct(name.alias("action"), kept.alias("reasons"), (F.coalesce(alert, F.lit(False)) if alert is not None else F.lit(False)).alias("alert"))

    def reasons(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(condition, why) for condition, why in pairs]))

    def because(why: str) -> Column:
        return decided("none", F.array(F.lit(why)))

    open_, never = unit["state"] == "open", unit["residence_days"].isNull()
    destroy = reasons((unit["retention_pending"], "retention_pending"), (unit["holds"] > 0, "held"), (~unit["approved"], "approval"))
    release = reasons(
        (seconds(unit["published_at"]) + grace_s > seconds(now), "grace"),
        (seconds(unit["newest_created"]) > seconds(now) - least_range_s, "recent_records"),
        (unit["old_leases"] > 0, "lease"),
        (~unit["backed_up"], "no_backup"),
    )
    return first_of(
        (~unit["category"].isin("completed", "audit"), because("not_tierable")),
        (~never & (residence < least_range_s), because("residence_below_range")),
        (unit["state"] == "destroyed", decided("none")),
        (~open_ & unit["retention_due"], decided("destroy", destroy)),
        (open_ & never, because("never")),
        (open_ & (due > seconds(now)), because("residence")),
        (open_, decided("seal", unit["blockers"], (F.size(unit["blockers"]) > 0) & (seconds(now) >= due + 30 * DAY))),
        ((unit["state"] == "sealed") & unit["immutable_route"] & unit["erasable"], because("immutable_route")),
        (unit["state"] == "sealed", decided("transfer")),
        (unit["state"] == "published", decided("release", release)),
        otherwise=decided("none"),
    )


def reservation(state: Column, past: Column, command: Column) -> Column:
    """struct(state, conflict, refused, resource, changed) of a command on a reservation branch ('absent': none)."""

    def answer(to: Column, resource: str = "none", changed: bool = False, conflict: bool = False, refused: str | None = None) -> Column:
        return F.struct(
            to.alias("state"), F.lit(conflict).alias("conflict"), F.lit(refused).cast("string").alias("refused"), F.lit(resource).alias("resource"), F.lit(changed).alias("changed")
        )

    def moved(to: str, resource: str = "none") -> Column:
        return answer(F.lit(to), resource, changed=True)

    stay, conflict = answer(state), answer(state, conflict=True)
    held, absent = state == "held", state == "absent"
    consuming = command.isin("consume-within", "consume-exact", "consume-beyond")
    return first_of(
        ((command == "hold-enough") & absent, moved("held", "take")),
        ((command == "hold-short") & absent, moved("rejected")),
        ((command == "hold-other") & (state != "cancelled"), conflict),
        ((command == "confirm") & held & past, moved("expired", "give_back")),
        ((command == "confirm") & held, moved("committed")),
        ((command == "cancel") & absent, moved("cancelled")),
        ((command == "cancel") & state.isin("held", "committed"), moved("released", "give_back")),
        ((command == "expire") & held & past, moved("expired", "give_back")),
        (command == "consume-used-other", conflict),
        (consuming & absent, answer(state, refused="absent")),
        (consuming & (state != "committed"), answer(state, refused="not_committed")),
        (command == "consume-beyond", answer(state, refused="beyond_remaining")),
        (command == "consume-exact", moved("consumed", "consume")),
        (command == "consume-within", moved("committed", "consume")),
        otherwise=stay,
    )


FINAL = ("succeeded", "failed", "rejected")


def resend_deadline(first: Column, last: Column, dedupe_s: Column, last_use: Column) -> Column:
    """Unix second until which a deduplicating system takes a repeated request, less a safety margin; null: never."""
    base = F.when(last_use & last.isNotNull(), last).otherwise(first)
    return F.when(dedupe_s > 0, base + dedupe_s - F.greatest(dedupe_s / 10, F.lit(float(HOUR))))


def external_command(facts: dict[str, Column], event: Column, result: Column, offers: dict[str, Column], now: Column) -> Column:
    """struct(state, why) of an external command after an event; times are unix seconds, null: none.

    ``facts``: state, deadline, expires, first, last, unknown_since, accepted_since, unrecorded, abandon; ``offers``:
    dedupe_s, last_use, query, processing_s. ``result`` is the event's result or the external record's state.
    """
    s = facts["state"]
    past = F.coalesce(now > facts["deadline"], F.lit(False))
    limit = facts["abandon"].isNotNull()
    latest = F.greatest(facts["last"], facts["unrecorded"])
    own = resend_deadline(facts["first"], facts["last"], offers["dedupe_s"], offers["last_use"])
    again = F.coalesce(now <= own, F.lit(False)) | F.coalesce(now > facts["expires"], F.lit(False)) | F.coalesce((offers["processing_s"] > 0) & (now - latest > offers["processing_s"]), F.lit(False))
    since = F.when(s == "accepted", facts["accepted_since"]).otherwise(facts["unknown_since"])
    long_ago = F.coalesce(now - since > DAY, F.lit(False))
    waiting = s.isin("unknown", "accepted")
    sent = (event == "send_result") & (s == "sending")

    def to(state: Column | str, why: str) -> Column:
        return F.struct((F.lit(state) if isinstance(state, str) else state).alias("state"), F.lit(why).alias("why"))

    return first_of(
        (s.isin(*FINAL), to(s, "final")),
        (F.coalesce(now > facts["abandon"], F.lit(False)) & s.isin("prepared", "retry_wait", "unknown"), to("failed", "expired")),
        ((event == "claim") & s.isin("prepared", "retry_wait") & past, to("unknown", "past_deadline")),
        ((event == "claim") & s.isin("prepared", "retry_wait"), to("sending", "claimed")),
        ((event == "before_send") & (s == "sending") & past, to("unknown", "past_deadline")),
        ((event == "before_send") & (s == "sending"), to("sending", "sent")),
        ((event == "lease_lost") & (s == "sending"), to("unknown", "claimant_gone")),
        (sent & (result == "not_reached"), to("retry_wait", "not_processed")),
        (sent & (result == "maybe_reached"), to("unknown", "maybe_processed")),
        (sent & (result == "accepted"), to("accepted", "accepted")),
        (sent & result.isin(*FINAL), to(result, "result")),
        ((event == "query_found") & waiting & result.isin("accepted", *FINAL), to(result, "external_record")),
        ((event == "query_found") & waiting, to(s, "external_not_final")),
        ((event == "query_unavailable") & waiting & long_ago & (s == "unknown") & limit, to(s, "waits_for_abandon_time")),
        ((event == "query_unavailable") & waiting & long_ago, to("manual", "manual_limit")),
        ((event == "query_unavailable") & waiting, to(s, "backoff")),
        ((event == "query_not_found") & (s == "unknown") & again, to("sending", "resendable")),
        ((event == "query_not_found") & (s == "unknown") & limit, to(s, "waits_for_abandon_time")),
        ((event == "query_not_found") & (s == "unknown"), to("manual", "may_still_land")),
        ((event == "finality_passed") & (s == "accepted") & offers["query"], to("accepted", "query")),
        ((event == "finality_passed") & (s == "accepted") & long_ago, to("manual", "manual_limit")),
        ((event == "finality_passed") & (s == "accepted"), to("accepted", "waits")),
        ((event == "registered") & (s == "manual"), to(result, "registered")),
        otherwise=to(s, "no_rule"),
    )


def approval(situation: dict[str, Column], choice: Column, others: Column, last: Column, on_reject: Column) -> Column:
    """struct(replay, refused, task, instance, supersede_others, next_step, changed) of a decision on a task.

    ``situation``: task, instance, version_matches, self, candidate, operation, qualification, revision_matches, replay.
    """
    s = situation
    refused = (
        F.when((s["task"] != "pending") | (s["instance"] != "running"), "TASK_NOT_PENDING")
        .when(~s["version_matches"], "VERSION_CONFLICT")
        .when(s["self"], "SELF_APPROVAL")
        .when(~s["candidate"], "NOT_ASSIGNEE")
        .when(~s["operation"], "PERMISSION_DENIED")
        .when(s["qualification"] == "not_qualified", "NOT_QUALIFIED")
        .when(s["qualification"] == "unknown", "QUALIFICATION_UNKNOWN")
        .when(~s["revision_matches"], "REVISION_CHANGED")
    )
    done = ~s["replay"] & refused.isNull()
    instance = F.when(~done, s["instance"]).when(choice == "reject", on_reject).when(last, "approved").otherwise("running")
    return F.struct(
        s["replay"].alias("replay"),
        F.when(~s["replay"], refused).alias("refused"),
        F.when(done, "decided").otherwise(s["task"]).alias("task"),
        instance.alias("instance"),
        (done & others).alias("supersede_others"),
        (done & (choice != "reject") & ~last).alias("next_step"),
        done.alias("changed"),
    )


# Outcomes of a decision after which an arriving action is delivered again.
TRY_AGAIN = ("AUTHORIZATION_UNPROVABLE", "QUALIFICATION_UNKNOWN", "DATABASE_ERROR")


def arriving_action(a: dict[str, Column]) -> Column:
    """struct(answer, reason, audit, record, notify_holder) of an action that arrives on a grant.

    ``a``: shape_ok, audience_is_self, stream_is_source, grant_exists, principal_matches, action_allowed, prior ('',
    same_action, other_action), clicked_in_time, processed_in_time, security_version_newer, decision.
    """

    def answer(name: str, reason: Column | str | None = None, audit: bool = False, record: bool = False, notify: bool = False) -> Column:
        why = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(name).alias("answer"), why.alias("reason"), F.lit(audit).alias("audit"), F.lit(record).alias("record"), F.lit(notify).alias("notify_holder"))

    def refuse(reason: Column | str, record: bool = False, notify: bool = False) -> Column:
        return answer("refused", reason, True, record, notify)

    return first_of(
        (~a["shape_ok"], refuse("malformed")),
        (~a["audience_is_self"], answer("ignored")),
        (~a["stream_is_source"], refuse("not_the_sender")),
        (~a["grant_exists"], refuse("unknown_grant")),
        (~a["principal_matches"], refuse("not_the_holder")),
        (~a["action_allowed"], refuse("action_not_allowed")),
        (a["prior"] == "same_action", answer("replayed")),
        (a["prior"] == "other_action", refuse("GRANT_USED", notify=True)),
        (~a["clicked_in_time"] | ~a["processed_in_time"], refuse("expired", True, True)),
        (a["security_version_newer"], refuse("GRANT_STALE", True, True)),
        (a["decision"] == "approved", answer("executed", record=True)),
        (a["decision"].isin(*TRY_AGAIN), answer("retry", a["decision"])),
        otherwise=refuse(a["decision"], True, True),
    )


def work_failure(kind: Column, attempts: Column, most: Column, effect: Column, outcome_unknown: Column, waited_s: Column, most_wait_s: Column) -> Column:
    """struct(state, attempts, wait_s) of a work item whose run failed; ``most_wait_s`` 0: no limit."""
    from recordloom.functions.keys import backoff_seconds, wait_seconds

    def to(state: str, tries: Column, wait: Column | None = None) -> Column:
        return F.struct(F.lit(state).alias("state"), tries.alias("attempts"), (F.lit(None).cast("double") if wait is None else wait.cast("double")).alias("wait_s"))

    unsure = (effect == "non_idempotent_external") & (kind != "not_effective") & outcome_unknown
    return first_of(
        ((kind == "wait") & (most_wait_s > 0) & (waited_s > most_wait_s), to("dead", attempts)),
        (kind == "wait", to("retry_wait", attempts - 1, wait_seconds(waited_s))),
        (kind == "permanent", to("dead", attempts)),
        (unsure, to("paused", attempts)),
        (attempts >= most, to("dead", attempts)),
        otherwise=to("retry_wait", attempts, backoff_seconds(attempts, 1.0, 300.0)),
    )


ALIGNMENT = "struct<state:string,action:string,confirmed:boolean,rollback:boolean,stalled_gen:bigint,prior:string>"


def alignment(now: Column, event: Column) -> Column:
    """struct ALIGNMENT of a source after one event: its state and the action.

    ``event``: kind, gen, matches, row_check. A generation counts only if it is above the one the source was stalled at.
    """
    kind, gen, state = event["kind"], event["gen"].cast("long"), now["state"]
    larger = now["stalled_gen"].isNull() | (gen > now["stalled_gen"])
    blocked, yes, no = state == "blocked", F.lit(True), F.lit(False)

    def to(action: str, **changed: Column | str) -> Column:
        new = {k: F.lit(v) if isinstance(v, str) else v for k, v in changed.items()} | {"action": F.lit(action)}
        return F.struct(*[new.get(f, now[f]).alias(f) for f in ("state", "action", "confirmed", "rollback", "stalled_gen", "prior")]).cast(ALIGNMENT)

    return first_of(
        (kind == "environment_copy", to("clear_and_refetch", state="aligning", rollback=no, confirmed=no)),
        ((kind == "foreign") & blocked, to("alert")),
        (kind == "foreign", to("alert_and_hold", state="blocked", prior=state)),
        (blocked & (kind == "operator_confirms"), to("record_confirmation", confirmed=yes)),
        (blocked & ((kind != "primary_response") | ~now["confirmed"]), to("hold")),
        (blocked & ~event["matches"], to("alert", confirmed=no)),
        (blocked & (now["prior"] == "stalled") & ~larger, to("refetch", confirmed=no, state="stalled")),
        (blocked & (event["row_check"] == "failed"), to("refetch", confirmed=no, state="stalled", rollback=yes, stalled_gen=gen)),
        (blocked, to("row_check_then_refetch", confirmed=no, state="aligning")),
        (kind == "rollback", to("refetch", state="stalled", rollback=yes, stalled_gen=gen)),
        ((state == "stalled") & (kind == "adopt_epoch") & larger, to("refetch", state="aligning")),
        (state == "stalled", to("keep_refetching")),
        (kind.isin("adopt_epoch", "first_contact", "beyond_retention"), to("refetch", state="aligning")),
        ((state == "aligning") & (kind == "alignment_done") & now["rollback"] & ~larger, to("alert", state="stalled")),
        ((state == "aligning") & (kind == "alignment_done"), to("watermark_from_echoes", state="aligned", rollback=no)),
        otherwise=to("alert"),
    )


def alignment_states(log: DataFrame, order: list[str], state: str = "aligning") -> DataFrame:
    """``source`` and the fields of ALIGNMENT after each source's log (source, kind, gen, matches, row_check) in order, folded in one
    aggregation; one source's log is a bounded group."""
    fields = ["kind", "gen", "matches", "row_check"]
    events = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    start = F.struct(F.lit(state).alias("state"), F.lit("none").alias("action"), F.lit(False).alias("confirmed"), F.lit(False).alias("rollback"), F.lit(None).cast("long").alias("stalled_gen"), F.lit(None).cast("string").alias("prior")).cast(ALIGNMENT)
    return log.groupBy("source").agg(F.aggregate(events, start, alignment).alias("o")).select("source", "o.*")
