"""Inboxes: each event has its effect once, failing events end as dead letters, chains of causes are bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.folds import latest, new_rows

MOST_HOPS = 10
MOST_DELIVERIES = 3


def admitted(events: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """Events whose chain of causes is not longer than allowed."""
    return events.where(F.coalesce("hops", F.lit(0)) <= most_hops)


def caused(events: DataFrame) -> DataFrame:
    """Events that a handler emits for these: the cause is the event, one hop further."""
    return events.withColumn("causation", F.col("event_id")).withColumn("hops", F.coalesce("hops", F.lit(0)) + 1)


def once(events: DataFrame, inbox: DataFrame, subscription: str) -> DataFrame:
    """The first delivery of each event that the subscription has not handled yet."""
    mine = inbox.where(F.col("subscription") == subscription).select("event_id")
    return new_rows(events, mine, ["event_id"], ["delivered_at", "seq"])


def dead_letters(failures: DataFrame) -> DataFrame:
    """Latest error of each (subscription, event) that failed on its last delivery."""
    last = failures.where(F.col("attempts") >= MOST_DELIVERIES)
    return latest(last, ["subscription", "event_id"], ["attempts", "failed_at"])


def receive(stream: DataFrame, inbox_path: str, checkpoint: str, subscription: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handle every event of a stream once, across restarts and repeats of any age.

    A micro-batch takes the events that the inbox, a Parquet table partitioned by batch, does not hold; a batch that is
    run again after a failure replaces its own partition and hands the same events to ``handle`` with the same number.
    Files are sorted by event, and only the range of the batch's events is looked up, so the scan skips older files where
    ids rise with time; ids in no order make each batch read the ids of the whole inbox.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        schema = "event_id string, subscription string"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{inbox_path}/batch=-1")  # so there is a table to read
        seen = spark.read.schema(f"{schema}, batch long").option("basePath", inbox_path).parquet(inbox_path).where(F.col("batch") < number)
        first, last = rows.agg(F.min(F.col("event_id").cast("string")), F.max(F.col("event_id").cast("string"))).first()
        fresh = admitted(once(rows, seen.where(F.col("event_id").between(first, last)), subscription)).persist()
        handle(fresh, number)
        told = fresh.select(F.col("event_id").cast("string").alias("event_id"), F.lit(subscription).alias("subscription"))
        told.sort("event_id").write.mode("overwrite").parquet(f"{inbox_path}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_within(stream: DataFrame, delay: str) -> DataFrame:
    """Each event once, where repeats come at most ``delay`` apart: the state of older events is dropped, so it stays
    bounded; for repeats of any age there is ``receive``."""
    return stream.withWatermark("delivered_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def quarantined(failures: DataFrame, now: Column, attempts: int = 3, seconds: int = 30) -> DataFrame:
    """``projection, subject``: subjects of events that failed often or long enough; an event without subjects stops
    the whole projection and is listed with a null subject."""
    due = failures.where((F.col("attempts") >= attempts) | (F.col("first_failed_at") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))))
    return due.select("projection", F.explode_outer("subjects").alias("subject")).distinct()
