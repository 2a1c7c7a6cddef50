"""Outboxes: events as rows with partition, digest and cause, and what readers ask of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.functions.canonical import row_digest
from recordloom.functions.keys import partition_of, subject
from recordloom.streaming.inbox import MOST_HOPS

PAGE = 500
# The form of an event's type, and the kinds of events.
TYPE = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"
KINDS = ("full", "partial", "delete")


def emitted(events: DataFrame, stream: str, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): outbox rows of events, and events that can't be emitted with the reason.

    ``events``: event_id, record_id, type, version, kind, payload (text), hops. Rows get partition, subject and digest;
    they stay unnumbered, since numbers are given after commit.
    """
    why = (
        F.when(F.col("record_id").isNull() | (F.col("record_id") == ""), "no_record")
        .when(~F.coalesce(F.col("type").rlike(TYPE), F.lit(False)), "type")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(F.coalesce(F.col("version"), F.lit(0)) <= 0, "version")
        .when(F.coalesce("hops", F.lit(0)) > MOST_HOPS, "hops")
    )
    told = events.withColumn("reason", why)
    part = partition_of(F.col("record_id"), partitions)
    good = told.where("reason IS NULL").drop("reason").withColumn("stream", F.lit(stream)).withColumn("partition", part)
    good = good.withColumn("subject", subject(F.col("stream"), F.col("partition"), F.col("type"))).withColumn("digest", row_digest(F.col("event_id"), F.col("payload")))
    return good, told.where("reason IS NOT NULL")


def numbered_stream(rows: DataFrame, schema: str) -> DataFrame:
    """The streaming twin of numbering: rows of each partition numbered in order of ``ord``, the counter kept between
    batches; a new epoch starts at 1. ``schema`` is that of the rows with ``seq long`` at its end."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (None, 0)
        whole = pd.concat(list(batches)).sort_values("ord", kind="stable").reset_index(drop=True)
        run = whole["epoch"].ne(whole["epoch"].shift()).cumsum()
        seq = whole.groupby(run).cumcount() + 1
        if whole["epoch"].iloc[0] == epoch:  # the first run goes on where the last batch ended
            seq += (run == 1) * last
        state.update((whole["epoch"].iloc[-1], int(seq.iloc[-1])))
        yield whole.assign(seq=seq.astype("int64"))[names]

    return rows.groupBy("partition").applyInPandasWithState(number, schema, "epoch string, last long", "append", GroupStateTimeout.NoTimeout)


def snapshot_page(records: DataFrame, after: str | None, size: int = PAGE) -> DataFrame:
    """Records after an id, in its order, one more than a page if there are more; ``records`` has ``record_id``."""
    rows = records if after is None else records.where(F.col("record_id") > after)
    return rows.orderBy("record_id").limit(size + 1)


TOKEN = "stream string, after string, impl string, epoch string"


def snapshot_token(stream: Column, after: Column, impl: Column, epoch: Column) -> Column:
    """The token of a snapshot's next page: its place, bound to the source's instance and epoch."""
    body = F.to_json(F.struct(stream.alias("stream"), after.alias("after"), impl.alias("impl"), epoch.alias("epoch")))
    plain = F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def snapshot_asked(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """``asked`` (request, stream, token) with ``after`` and ``problem``: null, 'token' (unreadable), 'other_stream', 'no_stream' (none
    is declared) or 'changed' (the source's instance or epoch is another, so the snapshot starts again). ``sources``: stream,
    impl, epoch."""
    text = F.translate("token", "-_", "+/")
    good = F.col("token").rlike("^[A-Za-z0-9_-]+$") & (F.length("token") % 4 != 1)
    whole = F.when(good, F.rpad(text, (F.ceil(F.length("token") / 4) * 4).cast("int"), "="))
    told = asked.withColumn("_t", F.from_json(F.decode(F.unbase64(whole), "UTF-8"), TOKEN)).withColumn("_has", F.coalesce(F.col("token") != "", F.lit(False)))
    told = told.withColumn("_bad", F.col("_has") & F.coalesce(F.col("_t.stream") == "", F.lit(True)))
    told = told.withColumn("_stream", F.when(F.col("_has"), F.col("_t.stream")).otherwise(F.col("stream")))
    known = told.join(sources.select(F.col("stream").alias("_stream"), F.col("impl").alias("_impl"), F.col("epoch").alias("_epoch")), "_stream", "left")
    problem = (
        F.when(F.col("_bad"), "token").when(F.col("_has") & (F.coalesce("stream", F.lit("")) != "") & (F.col("stream") != F.col("_stream")), "other_stream").when(F.col("_impl").isNull(), "no_stream")
        .when(F.col("_has") & ~(F.col("_t.impl").eqNullSafe(F.col("_impl")) & F.col("_t.epoch").eqNullSafe(F.col("_epoch"))), "changed")
    )
    return known.select("request", "stream", "token", F.when(problem.isNull() & F.col("_has"), F.col("_t.after")).alias("after"), problem.alias("problem"))


def after_positions(outbox: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Rows (partition, seq) of each asked partition (partition, after) after a position, ``limit`` at most, with ``after``
    and ``first``, the partition's first row after it. Numbers have no gap but for what retention took from the start, so the
    page is a range of them and no rows beyond it are sorted."""
    kept = outbox.groupBy("partition").agg(F.min("seq").alias("_least"), F.max("seq").alias("_most")).join(asked, "partition").where("_most > after")
    pages = kept.select("partition", "after", F.greatest(F.col("after") + 1, F.col("_least")).alias("first"))
    return outbox.join(pages, "partition").where((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("first") + limit))


def read_after(outbox: DataFrame, asked: DataFrame, limit: int = PAGE) -> DataFrame:
    """Rows of each asked partition after a position, ``limit`` at most; ``reset`` where the next row is gone though
    later ones are there. ``asked``: partition, after."""
    return after_positions(outbox, asked, limit).withColumn("reset", F.col("first") > F.col("after") + 1).drop("first", "after")


def unpublished(outbox: DataFrame) -> DataFrame:
    """``stream, partition`` with rows that are not numbered or not published."""
    return outbox.where("seq IS NULL OR published_at IS NULL").select("stream", "partition").distinct()


def purged(outbox: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(kept, positions): rows that retention keeps, and each partition's greatest purged position."""
    old = F.col("published_at").isNotNull() & (F.col("published_at") < now - F.make_dt_interval(F.lit(days)))
    positions = outbox.where(old).groupBy("stream", "partition").agg(F.max("position").alias("purged"))
    return outbox.where(~F.coalesce(old, F.lit(False))), positions


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Incomplete rows after their source's current answers (record_id, state, version, data): whole content of a
    version that is new enough completes them; a deletion or purge leaves a tombstone; others stay."""
    told = rows.join(answers.select("record_id", F.col("state").alias("answer"), F.col("version").alias("found"), F.col("data").alias("content")), "record_id", "left")
    open_ = F.col("state") == "incomplete"
    whole = open_ & (F.col("answer") == "exists") & (F.col("found") >= F.col("need_version"))
    gone = open_ & (((F.col("answer") == "tombstone") & (F.col("found") >= F.col("version"))) | (F.col("answer") == "purged"))
    state = F.when(whole, "complete").when(gone, "tombstone").otherwise(F.col("state"))
    version = F.when(whole, F.col("found")).when(gone & (F.col("answer") == "purged"), F.lit(0)).when(gone, F.col("found")).otherwise(F.col("version"))
    data = F.when(whole, F.col("content")).when(~F.coalesce(gone, F.lit(False)), F.col("data"))
    need = F.when(~(F.coalesce(whole, F.lit(False)) | F.coalesce(gone, F.lit(False))), F.col("need_version"))
    return told.select("record_id", state.alias("state"), version.cast("long").alias("version"), need.alias("need_version"), data.alias("data"))
