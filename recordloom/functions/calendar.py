"""Business dates and time tables in named zones, with daylight-saving changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BACKLOG = 24


def business_date(at: Column, zone: str | Column) -> Column:
    """Local date of an instant (timestamp in a UTC session) in a zone."""
    if isinstance(zone, str) and zone in ("", "Local"):
        raise ValueError("a business date needs a named zone")
    return F.to_date(F.from_utc_timestamp(at, zone))


@dataclass(frozen=True)
class TimeTable:
    """Minutes, hours, days, months and weekdays (0: Sunday) of a five-field expression."""

    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    either_day: bool  # both day fields restrict: one of them is enough


def _values(spec: str, low: int, high: int) -> tuple[int, ...]:
    found: set[int] = set()
    for item in spec.split(","):
        span, _, step = item.partition("/")
        stride = int(step) if step else 1
        if span == "*":
            first, last = low, high
        elif "-" in span:
            first, last = (int(x) for x in span.split("-", 1))
        else:
            first = int(span)
            last = high if stride > 1 else first
        if stride < 1 or not low <= first <= last <= high:
            raise ValueError(f"{item!r} is not within {low}-{high}")
        found.update(range(first, last + 1, stride))
    return tuple(sorted(found))


def parse_time_table(expression: str) -> TimeTable:
    """Lists, ranges and steps of minute, hour, day of month, month and day of week (0 and 7: Sunday)."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"{expression!r} has not five fields")
    minutes, hours, days, months = (_values(f, *bounds) for f, bounds in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12)), strict=False))
    weekdays = tuple(sorted({d % 7 for d in _values(fields[4], 0, 7)}))
    return TimeTable(minutes, hours, days, months, weekdays, fields[2] != "*" and fields[4] != "*")


def wall_instant(wall: Column, zone: str) -> Column:
    """UTC instant of a local time: the first occurrence where clocks go back, the first moment after a jump forward.

    A local time that the round trip does not give back does not exist; the end of its gap is the first quarter
    hour of UTC, of those around it, whose local time is not before it (zone changes fall on quarter hours).
    """
    naive = F.to_utc_timestamp(wall, zone)
    exists = F.from_utc_timestamp(naive, zone) == wall
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp(naive) / 900) * 900 - 3 * 3600)
    around = F.sequence(quarter, quarter + F.expr("INTERVAL 6 HOURS"), F.expr("INTERVAL 15 MINUTES"))
    after = F.array_min(F.filter(around, lambda t: F.from_utc_timestamp(t, zone) >= wall))
    # clocks going back: the earlier of the instants that show this time
    earlier = F.array_min(F.filter(F.transform(F.array(*[F.lit(m) for m in (15, 30, 60, 120)]), lambda m: naive - F.make_dt_interval(F.lit(0), F.lit(0), m)), lambda t: F.from_utc_timestamp(t, zone) == wall))
    return F.when(exists, F.coalesce(earlier, naive)).otherwise(after)


def slots_between(spans: DataFrame, keys: list[str], expression: str, zone: str) -> DataFrame:
    """``keys, slot, at``: the time table's slots whose instant is in (after, until] of each span (keys, after, until; instants)."""
    t = parse_time_table(expression)
    days = F.sequence(F.to_date(F.from_utc_timestamp("after", zone)) - F.expr("INTERVAL 1 DAY"), F.to_date(F.from_utc_timestamp("until", zone)) + F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 DAY"))
    rows = spans.select(*keys, "after", "until", F.explode(days).alias("day")).withColumn("day", F.to_date("day"))
    of_month, of_week = F.dayofmonth("day").isin(list(t.days)), (F.dayofweek("day") - 1).isin(list(t.weekdays))
    rows = rows.where(F.month("day").isin(list(t.months)) & ((of_month | of_week) if t.either_day else (of_month & of_week)))
    rows = rows.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in t.hours]))).withColumn("minute", F.explode(F.array(*[F.lit(m) for m in t.minutes])))
    wall = F.make_timestamp(F.year("day"), F.month("day"), F.dayofmonth("day"), F.col("hour"), F.col("minute"), F.lit(0).cast("decimal(8,6)"))
    rows = rows.withColumn("at", wall_instant(wall, zone)).where("at > after AND at <= until")
    return rows.select(*keys, F.format_string("%sT%02d:%02d", F.date_format("day", "yyyy-MM-dd"), "hour", "minute").alias("slot"), "at")


def slots(spark: SparkSession, expression: str, zone: str, after: str, until: str) -> DataFrame:
    """``slot, at``: the slots of one span, both ends UTC texts."""
    span = spark.sql("SELECT 1 AS one").select(F.to_timestamp(F.lit(after)).alias("after"), F.to_timestamp(F.lit(until)).alias("until"))
    return slots_between(span, [], expression, zone)


def backfill(due: DataFrame, policy: str, now: str, most: int = MOST_BACKLOG, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, slot, at, state``: due slots of each time table (``by``) by policy: ``latest`` keeps the last, ``all`` pauses those
    beyond ``most``, ``none`` keeps those at most a minute old. A time table's due slots are few, so one window orders them."""
    own = Window.partitionBy(*(by or [F.lit(1)]))
    if policy == "all":
        return due.withColumn("state", F.when(F.row_number().over(own.orderBy("at", "slot")) <= most, "pending").otherwise("paused"))
    if policy == "none":
        return due.where(F.to_timestamp(F.lit(now)) - F.col("at") <= F.expr("INTERVAL 1 MINUTE")).withColumn("state", F.lit("pending"))
    last = F.row_number().over(own.orderBy(F.col("at").desc(), F.col("slot").desc()))
    return due.withColumn("place", last).where("place = 1").select(*by, "slot", "at", F.lit("pending").alias("state"))
