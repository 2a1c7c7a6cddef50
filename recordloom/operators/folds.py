"""Numbering, positions, progress, budgets and fixpoints over event and record logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, partition: list[str], order: list[str], counters: DataFrame | None = None, ranges: int = 0) -> DataFrame:
    """``rows`` with a gap-free ``seq`` in each partition, from the counter's ``last_seq`` on (0 without one).

    A new epoch is a new partition value, so it starts at 1. Without ``ranges`` the window is one sort within partitions of a
    stream, for bounded ones. With it, rows are dealt by that many ranges of partition and order, and each range starts where the
    ones before it end, so a few large partitions are as many tasks; the dealt rows are kept, since ranges come from a sample.
    """
    if ranges:
        from recordloom.sources.tables import checkpointed

        dealt = checkpointed(rows.repartitionByRange(ranges, *partition, *order).withColumn("_part", F.spark_partition_id()))
        sizes = dealt.groupBy(*partition, "_part").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*[F.col(c).alias(f"_{c}_of") for c in partition], F.col("_part").alias("_part_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
        same = F.col("_part") == F.col("_part_of")
        for c in partition:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
        place = (F.row_number().over(Window.partitionBy(*partition, "_part").orderBy(*order)) + F.col("_first")).cast("long")
        rows = dealt.join(starts, same).withColumn("_place", place).drop("_part", "_part_of", "_first", *[f"_{c}_of" for c in partition])
    else:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    if counters is None:
        return rows.withColumnRenamed("_place", "seq")
    joined = rows.join(counters.select(*partition, "last_seq"), partition, "left")
    return joined.withColumn("seq", F.col("_place") + F.coalesce("last_seq", F.lit(0))).drop("last_seq", "_place")


def numbered_in_ranges(rows: DataFrame, order: list[str], start: int = 0, parts: int = 200) -> DataFrame:
    """One gap-free ``seq`` over all rows in a total order, without one task holding them.

    Rows are dealt by ranges of the order; counts of the ranges (``parts`` rows) give each its start. Ranges come from
    a sample, so the dealt rows are kept in the checkpoint folder: both passes, and a task that runs again, see the same.
    """
    from recordloom.sources.tables import checkpointed

    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", first.alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("seq", (place + F.col("_first") + start).cast("long")).drop("_part", "_first")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` of each key; partial maxima meet in the shuffle, not rows."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def contiguous(rows: DataFrame, keys: list[str], base: str, seq: str = "seq") -> DataFrame:
    """Rows that continue ``base`` (a column, the last applied position) without a hole; repeats count once."""
    once = rows.dropDuplicates([*keys, seq]).where(F.col(seq) > F.col(base))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return once.withColumn("_place", place).where(F.col(seq) - F.col("_place") == F.col(base)).drop("_place")


def watermark(marks: DataFrame, keys: list[str], mark: str, alias: str = "watermark") -> DataFrame:
    """Smallest mark of each key, null if any of its partitions has none."""
    whole = (F.count_if(F.col(mark).isNull()) == 0) & (F.count("*") > 0)
    return marks.groupBy(*keys).agg(F.when(whole, F.min(mark)).alias(alias))


def fresh_within(marks: DataFrame, mark: str, days: list[int]) -> DataFrame:
    """``days, fresh``: whether every partition's mark is at most so many days older than the newest; one aggregation for all."""
    ends = marks.agg(F.min(mark).alias("_low"), F.max(mark).alias("_high"), F.count_if(F.col(mark).isNull()).alias("_none"))
    asked = ends.select("*", F.explode(F.array(*[F.lit(d) for d in days])).alias("days"))
    return asked.select("days", F.coalesce((F.col("_none") == 0) & (F.col("_low") >= F.col("_high") - F.make_dt_interval(F.col("days"))), F.lit(False)).alias("fresh"))


def no_older_than(marks: DataFrame, mark: str, at: Column) -> DataFrame:
    """One row ``fresh``: whether every partition's mark reaches ``at``; false without partitions."""
    return marks.agg(F.coalesce(F.bool_and(F.coalesce(F.col(mark) >= at, F.lit(False))), F.lit(False)).alias("fresh"))


def last_echo(echoes: DataFrame, keys: list[str], reach: str) -> DataFrame:
    """``keys, mark``: the largest pull time of the recorded echoes within the contiguous range."""
    return echoes.groupBy(*keys).agg(F.max(F.when(F.col("recorded") & (F.col("seq") <= F.col(reach)), F.col("pulled_at"))).alias("mark"))


def minute_budget(denials: DataFrame, keys: list[str], at: str, order: list[str], detailed: int = 20) -> DataFrame:
    """``denials`` with ``minute`` and ``detail``: the first ``detailed`` of a key and minute are kept in detail."""
    minute = denials.withColumn("minute", F.date_trunc("minute", at))
    place = F.row_number().over(Window.partitionBy(*keys, "minute").orderBy(*order))
    return minute.withColumn("detail", place <= detailed)


def overflow(denials: DataFrame, keys: list[str], at: str, detailed: int = 20) -> DataFrame:
    """``keys, minute, overflow, first_at, last_at`` of the minutes with more than ``detailed`` denials."""
    counts = denials.groupBy(*keys, F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return counts.where(F.col("n") > detailed).select(*keys, "minute", (F.col("n") - detailed).alias("overflow"), "first_at", "last_at")


def cut(runs: DataFrame, handled: DataFrame, lifetime: Column, keys: list[str]) -> DataFrame:
    """``keys, cut``: the last handling, less ``lifetime``, of the latest run that had lasted that long by then.

    ``runs``: keys, started_at; ``handled``: keys, at. Runs and handlings meet in one union whose running maximum of
    the start names each handling's run, so there is no range join.
    """
    events = runs.select(*keys, F.col("started_at").alias("at"), F.col("started_at").alias("start")).unionByName(handled.select(*keys, "at", F.lit(None).cast(runs.schema["started_at"].dataType).alias("start")))
    order = Window.partitionBy(*keys).orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    of_run = events.withColumn("run", F.max("start").over(order)).where("start IS NULL AND run IS NOT NULL")
    ends = of_run.groupBy(*keys, "run").agg((F.max("at") - lifetime).alias("cut")).where("run <= cut")
    return ends.groupBy(*keys).agg(F.max_by("cut", "run").alias("cut"))


def progress(handled: DataFrame, cuts: DataFrame, keys: list[str], source: list[str]) -> DataFrame:
    """``keys, source, position``: the greatest position handled at or before the cut; rows without a cut have none."""
    early = handled.where("position IS NOT NULL").join(cuts, keys).where("at <= cut")
    return early.groupBy(*keys, *source).agg(F.max("position").alias("position"))


def redelivery_starts(seen: DataFrame, progress_: DataFrame) -> DataFrame:
    """``component, stream, partition, impl, position``: where a redelivery of a partition starts.

    The smallest progress over all subscriptions that read the stream, if each has one there, of one instance; other
    partitions start at the first row kept and are left out. ``seen``: subscription, component, stream.
    """
    readers = seen.distinct().groupBy("component", "stream").agg(F.count("*").alias("readers"))
    starts = progress_.groupBy("component", "stream", "partition").agg(
        F.count_distinct("subscription").alias("have"), F.count_distinct("impl").alias("instances"), F.min("impl").alias("impl"), F.min("position").alias("position")
    )
    whole = starts.join(readers, ["component", "stream"]).where("have = readers AND instances = 1")
    return whole.select("component", "stream", "partition", "impl", "position")


def resend_coverage(asked: DataFrame, counters: DataFrame, forks: DataFrame) -> DataFrame:
    """``asked`` with ``beyond, ahead``: whether rows after a start were purged, and whether the start is past all there is.

    ``asked``: stream, partition, epoch (struct), after_seq (null: from the first row); ``counters``: stream, partition,
    epoch, last_seq, purged (position struct); ``forks``: stream, partition, old_epoch, fork_seq.
    """
    keys = ["stream", "partition"]
    rows = asked.join(counters.select(*keys, F.col("epoch").alias("now_epoch"), "last_seq", "purged", F.lit(True).alias("known")), keys, "left")
    rows = rows.join(forks.select(*keys, F.col("old_epoch").alias("epoch"), "fork_seq"), [*keys, "epoch"], "left")
    start = F.struct(F.col("epoch.generation"), F.col("epoch.timeline"), F.col("after_seq"))
    some = F.col("after_seq").isNotNull()
    beyond = F.col("purged").isNotNull() & (~some | (start < F.col("purged")))
    ahead = F.when(~some, False).when(F.col("known").isNull(), True).when(F.col("epoch") == F.col("now_epoch"), F.col("after_seq") > F.col("last_seq")).when(F.col("fork_seq").isNull(), True).otherwise(F.col("after_seq") > F.col("fork_seq"))
    return rows.select(*asked.columns, F.coalesce(beyond, F.lit(False)).alias("beyond"), ahead.alias("ahead"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-nothing: the first incoming row of each key that is not there yet."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    fresh = first.join(existing.select(*keys), keys, "left_anti")
    return fresh.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*incoming.columns)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: each key's row of the greatest order among both sides; the incoming one on ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).drop("_new")


def closure(roots: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """``node``: all nodes reached from ``roots`` (node) along ``edges`` (source, target), round by round.

    Each round joins only the last round's nodes. Lineage is cut by a checkpoint every few rounds.
    """
    from recordloom.sources.tables import checkpointed

    found = frontier = roots.select("node").distinct()
    for step in range(most):
        frontier = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node")).distinct().join(found, "node", "left_anti")
        frontier = checkpointed(frontier)
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if step % 8 == 7:
            found = checkpointed(found)
    raise RuntimeError("the closure did not settle")


def receipts_settled(rows: DataFrame, current: str, covered_seq: int, ancestors: DataFrame, backed_up: bool, now: Column, least_age: Column) -> DataFrame:
    """``rows`` with ``settled``: 'delete', 'resend' or 'keep' of received records by their receipt.

    Covered receipts that are old enough go; receipts past an ancestor's fork point, or of an epoch on a lost branch,
    are sent again. ``ancestors``: epoch, fork_seq (one for each older epoch on the current history).
    """
    from recordloom.functions.keys import epoch_of

    told = rows.join(ancestors.select(F.col("epoch").alias("receipt_epoch"), "fork_seq"), "receipt_epoch", "left")
    old = F.col("received_at") < now - least_age
    here = F.col("receipt_epoch") == current
    older = F.col("fork_seq").isNotNull() & ~here
    lost = F.col("receipt_epoch").isNotNull() & ~here & ~older & ~(epoch_of(F.col("receipt_epoch")) > epoch_of(F.lit(current)))
    settled = (
        F.when(F.col("transfer_state") != "received", "keep")
        .when(here & (F.col("receipt_seq") <= covered_seq) & old, "delete")
        .when(older & (F.col("receipt_seq") > F.col("fork_seq")), "resend")
        .when(older & old & F.lit(backed_up), "delete")
        .when(lost, "resend")
        .otherwise("keep")
    )
    return told.withColumn("settled", settled).drop("fork_seq")


def dense_numbers(requests: DataFrame, series: list[str], order: list[str], used: DataFrame) -> DataFrame:
    """``requests`` with ``number``: gap-free document numbers of each series after the largest used one."""
    return numbered(requests, series, order, used.withColumnRenamed("max_used", "last_seq")).withColumnRenamed("seq", "number")


def voided_numbers(series: DataFrame) -> DataFrame:
    """``series, number`` of the numbers that raising a series from ``before`` to ``after`` leaves unused."""
    raised = series.where("after > before")
    return raised.select("series", F.explode(F.sequence(F.col("before") + 1, F.col("after"))).alias("number"))


def idempotent(commands: DataFrame, order: list[str], hours: int = 24) -> DataFrame:
    """``commands`` with ``outcome`` by (principal, key): the first 'runs', an equal fingerprint within ``hours`` of it
    'replays', another one 'conflicts'; after that the key is free again and its next command runs.

    The chain of windows of one key is a bounded fold of that key's commands in time order.
    """
    import pandas as pd

    names = [f.name for f in commands.schema.fields]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        outcomes, started, print_ = [], None, None
        for at, told in zip(pdf["at"], pdf["fingerprint"], strict=True):
            if started is None or at - started >= pd.Timedelta(hours=hours):
                started, print_ = at, told
                outcomes.append("runs")
            else:
                outcomes.append("replays" if told == print_ else "conflicts")
        return pdf[names].assign(outcome=outcomes)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in commands.schema.fields) + ", outcome string"
    return commands.groupBy("principal", "key").applyInPandas(fold, schema)
