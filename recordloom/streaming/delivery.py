"""Delivery of a stream's rows: numbers with the forks of epochs, redelivery after a wait, publishing in order.

State lives in Spark's state store (``transformWithState``, which needs the RocksDB provider); every stream here has a batch
twin that gives the same rows for the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Deliveries of an event, and seconds of the first and the longest wait between them.
MOST_DELIVERIES, FIRST_WAIT_S, LONGEST_WAIT_S = 3, 1, 30
NO_OUTCOME = "no outcome"

NUMBERED = "kind string, partition int, epoch string, ord long, seq long, old_epoch string, fork_seq long"
DELIVERED = "event_id string, attempt int, outcome string, cause string, at timestamp"

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- numbers and forks ------------------------------------------------------------------------------------------


class _Numbering(StatefulProcessor):
    """A partition's epoch and last number; a row of another epoch starts at 1 and tells where the old one ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "epoch string, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values("ord", kind="stable").reset_index(drop=True)
        epoch, last = self._last.get() if self._last.exists() else (None, 0)
        run = whole["epoch"].ne(whole["epoch"].shift()).cumsum()
        seq = whole.groupby(run).cumcount() + 1
        if whole["epoch"].iloc[0] == epoch:  # the first run goes on where the last batch ended
            seq += (run == 1) * last
        ends = pd.DataFrame({"epoch": whole["epoch"], "seq": seq}).groupby(run).last()
        before = [(epoch, last), *ends.itertuples(index=False, name=None)]
        forks = [("fork", key[0], new, None, None, *old) for old, new in zip(before, ends["epoch"], strict=False) if old[0] is not None and old[0] != new]
        self._last.update((str(ends["epoch"].iloc[-1]), int(ends["seq"].iloc[-1])))
        names = [x.split()[0] for x in NUMBERED.split(", ")]
        told = pd.DataFrame({"kind": "row", "partition": key[0], "epoch": whole["epoch"], "ord": whole["ord"], "seq": seq, "old_epoch": None, "fork_seq": None})
        for part in (told, pd.DataFrame(forks, columns=names)):
            if len(part):
                yield part[names].astype({"partition": "int32", "ord": "Int64", "seq": "Int64", "fork_seq": "Int64"})

    def close(self) -> None:
        pass


def numbered_stream(rows: DataFrame) -> DataFrame:
    """NUMBERED rows of a stream (partition, epoch, ord): each partition's rows in the order of ``ord`` with ``seq`` (kind 'row'), and
    one of kind 'fork' for each change of its epoch, within a batch or between two: the old epoch and its last number."""
    return rows.groupBy("partition").transformWithStateInPandas(_Numbering(), outputStructType=NUMBERED, outputMode="append", timeMode="None")


def numbered_batch(rows: DataFrame) -> DataFrame:
    """The batch twin of ``numbered_stream``."""
    order = Window.partitionBy("partition").orderBy("ord")
    new = ~F.col("epoch").eqNullSafe(F.lag("epoch").over(order))
    runs = rows.select("partition", "epoch", "ord", new.alias("_new")).withColumn("_run", F.sum(F.col("_new").cast("int")).over(order))
    told = runs.withColumn("seq", F.row_number().over(Window.partitionBy("partition", "_run").orderBy("ord")).cast("long"))
    none = F.lit(None)
    numbered = told.select(F.lit("row").alias("kind"), "partition", "epoch", "ord", "seq", none.cast("string").alias("old_epoch"), none.cast("long").alias("fork_seq"))
    before = told.select("*", F.lag("epoch").over(order).alias("old_epoch"), F.lag("seq").over(order).alias("fork_seq")).where("_new AND old_epoch IS NOT NULL")
    forks = before.select(F.lit("fork").alias("kind"), "partition", "epoch", none.cast("long").alias("ord"), none.cast("long").alias("seq"), "old_epoch", "fork_seq")
    return numbered.unionByName(forks)


# --- redelivery -------------------------------------------------------------------------------------------------


def wait_seconds(attempt: int) -> int:
    """Seconds from a failed delivery to the next one."""
    return min(LONGEST_WAIT_S, FIRST_WAIT_S << (attempt - 1))


class _Redelivery(StatefulProcessor):
    """An event's deliveries: a failed one waits for a timer; before the last one its dead letter is told in a batch of its own."""

    def __init__(self, handle: Callable[[dict[str, Any], int], str | None], fields: list[str]):
        self._handle, self._fields = handle, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        import json

        self._json, self._state = json, handle
        self._event = handle.getValueState("event", "body string, attempt int, armed boolean")

    def _told(self, key: Any, attempt: int, outcome: str, cause: str | None, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"event_id": [key[0]], "attempt": [attempt], "outcome": [outcome], "cause": [cause], "at": [pd.Timestamp(ms, unit="ms")]})

    def _deliver(self, key: Any, body: str, attempt: int, ms: int) -> Iterator[pd.DataFrame]:
        cause = self._handle(self._json.loads(body), attempt)
        if cause is None:
            yield self._told(key, attempt, "ack", None, ms)
            self._event.clear()
        elif attempt >= MOST_DELIVERIES:
            yield self._told(key, attempt, "dead", cause, ms)
            self._event.clear()
        else:
            yield self._told(key, attempt, "nak", cause, ms)
            self._event.update((body, attempt + 1, False))
            self._state.registerTimer(ms + 1000 * wait_seconds(attempt))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch.sort_values("at").to_dict("records"):
                if not self._event.exists():  # a repeat of an event that waits changes nothing
                    body = self._json.dumps({k: row[k] for k in self._fields}, default=str)
                    yield from self._deliver(key, body, 1, int(row["at"].timestamp() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        body, attempt, armed = self._event.get()
        if attempt >= MOST_DELIVERIES and not armed:
            yield self._told(key, attempt, "dead", NO_OUTCOME, ms)
            self._event.update((body, attempt, True))
            self._state.registerTimer(ms + 1)
        else:
            yield from self._deliver(key, body, attempt, ms - armed)

    def close(self) -> None:
        pass


def redelivered_stream(events: DataFrame, handle: Callable[[dict[str, Any], int], str | None]) -> DataFrame:
    """DELIVERED rows: every delivery of a stream's events and its outcome.

    ``events`` has event_id, ``at`` (a watermark column: timers follow event time) and what ``handle(event, attempt)`` needs; it
    returns None, or the cause of a failure. A failed delivery ('nak') is followed by another after 1, 2, ... 30 seconds. Before
    the last one a row 'dead' without an outcome is told in a batch of its own, so a run that ends while handling leaves
    it; the last delivery's own row, 'ack' or 'dead' with its cause, replaces it (``dead_letters``).
    """
    fields = [c for c in events.columns if c != "at"]
    return events.groupBy("event_id").transformWithStateInPandas(_Redelivery(handle, fields), outputStructType=DELIVERED, outputMode="append", timeMode="EventTime")


def redelivered_batch(events: DataFrame, failures: Column) -> DataFrame:
    """The batch twin for events whose first ``failures`` deliveries fail: event_id, attempt, outcome, at."""
    last = F.least(failures + 1, F.lit(MOST_DELIVERIES))
    attempts = events.select("event_id", "at", failures.alias("_f"), F.explode(F.sequence(F.lit(1), last)).alias("attempt"))
    waits = F.aggregate(F.sequence(F.lit(0), F.col("attempt") - 1), F.lit(0), lambda s, k: s + F.when(k > 0, F.least(F.lit(LONGEST_WAIT_S), F.lit(FIRST_WAIT_S) * F.pow(F.lit(2), k - 1).cast("int"))).otherwise(0))
    at = F.col("at") + F.make_dt_interval(secs=waits)
    outcome = F.when(F.col("attempt") > F.col("_f"), "ack").when(F.col("attempt") >= MOST_DELIVERIES, "dead").otherwise("nak")
    told = attempts.select("event_id", F.col("attempt").cast("int").alias("attempt"), outcome.alias("outcome"), at.alias("at"))
    early = told.where(F.col("attempt") >= MOST_DELIVERIES).withColumn("outcome", F.lit("dead")).withColumn("_early", F.lit(True))
    return told.withColumn("_early", F.lit(False)).unionByName(early).select("event_id", "attempt", "outcome", F.when(F.col("_early"), NO_OUTCOME).alias("no_outcome"), "at")


def dead_letters(delivered: DataFrame) -> DataFrame:
    """``event_id, cause`` of the events that are dead letters: a cause of the last delivery replaces 'no outcome', an 'ack' takes it away."""
    rank = F.when(F.col("outcome") == "ack", 2).when((F.col("outcome") == "dead") & (F.col("cause") != NO_OUTCOME), 1).otherwise(0)
    last = delivered.where("outcome <> 'nak'").groupBy("event_id").agg(F.max_by(F.struct("outcome", "cause"), rank).alias("l"))
    return last.where("l.outcome = 'dead'").select("event_id", "l.cause")


# --- publishing in order ----------------------------------------------------------------------------------------


def published_in_order(rows: DataFrame, send: Callable[[Row], None]) -> DataFrame:
    """``partition, seq, sent, cause``: rows (partition, seq, payload) sent in the order of ``seq`` within each partition.

    The first row whose ``send`` raises stops its partition, and no other: what follows it there is not sent.
    """
    names = rows.columns

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped: set[int] = set()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                told = Row(*names)(*row)
                cause = "after a failure" if told.partition in stopped else None
                if cause is None:
                    try:
                        send(told)
                    except Exception as e:  # noqa: BLE001  whatever a transport raises stops its partition
                        stopped.add(told.partition)
                        cause = f"{type(e).__name__}: {e}"
                out.append((told.partition, told.seq, cause is None, cause))
            yield pd.DataFrame(out, columns=["partition", "seq", "sent", "cause"])

    return rows.repartition("partition").sortWithinPartitions("partition", "seq").mapInPandas(publish, "partition int, seq long, sent boolean, cause string")


def forward(stream: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], send: Callable[[Row], None]) -> StreamingQuery:
    """Publish a stream of numbered rows (partition, seq, payload), each partition in the order of ``seq``, at least once.

    A micro-batch takes what the one before it held back and its own rows, prepares them all (``prepare``: large payloads go to a
    store, in parallel and before anything is sent), and sends them. Rows from a partition's first failure on are held in
    ``<folder>/held/batch=<n>`` for the next one, so none is passed over; what was sent stands in ``<folder>/sent/batch=<n>``. A
    batch that runs again takes the same rows and replaces its own folders.
    """

    def batch(own: DataFrame, number: int) -> None:
        spark, names = own.sparkSession, own.columns
        spark.createDataFrame([], own.schema).write.mode("ignore").parquet(f"{folder}/held/batch={number - 1}")
        held = spark.read.schema(own.schema).parquet(f"{folder}/held/batch={number - 1}")
        due = prepare(held.unionByName(own)).persist()
        told = published_in_order(due, send)
        told.write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")
        told = spark.read.schema(told.schema).parquet(f"{folder}/sent/batch={number}")
        left = held.unionByName(own).join(told.where("NOT sent").select("partition", "seq"), ["partition", "seq"], "left_semi")
        left.select(names).write.mode("overwrite").parquet(f"{folder}/held/batch={number}")
        due.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
