"""Keys, positions and names of event streams and archive objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a offset and the low part of its prime, 2^40 + 435.
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
MASK = 0xFFFFFFFF


def partition_of(record_id: Column, partitions: Column | int) -> Column:
    """Partition of a record: FNV-1a of the lower-cased id's bytes, unsigned, modulo the partition count.

    Two 32-bit halves keep every product within a long, so nothing overflows.
    """
    count = F.lit(partitions) if isinstance(partitions, int) else partitions
    digits = F.hex(F.encode(F.lower(record_id), "UTF-8"))
    places = F.sequence(F.lit(1), F.char_length(digits) - 1, F.lit(2))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.char_length(digits) > 0, octets).otherwise(F.array().cast("array<bigint>"))

    def step(state: Column, octet: Column) -> Column:
        low = state["low"].bitwiseXOR(octet)
        product = low * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("high"), product.bitwiseAND(F.lit(MASK)).alias("low"))

    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("high"), F.lit(FNV_LOW).cast("long").alias("low"))
    hashed = F.aggregate(octets, start, step)
    return (((hashed["high"] % count) * (F.lit(1 << 32) % count) + hashed["low"] % count) % count).cast("int")


def epoch_of(text: Column) -> Column:
    """struct(generation, timeline) of '<generation>.<timeline>', null if malformed; structs compare in order."""
    good = text.rlike(r"^[0-9]{1,18}\.[0-9]{1,18}$")
    return F.when(good, F.struct(F.split_part(text, F.lit("."), F.lit(1)).cast("long").alias("generation"), F.split_part(text, F.lit("."), F.lit(2)).cast("long").alias("timeline")))


def position(epoch: Column, seq: Column) -> Column:
    """struct(generation, timeline, seq): a place in a partition, ordered by epoch, then sequence."""
    return F.struct(epoch["generation"].alias("generation"), epoch["timeline"].alias("timeline"), seq.cast("long").alias("seq"))


def subject(stream: Column, partition: Column, event_type: Column) -> Column:
    return F.concat_ws(".", stream, partition.cast("string"), event_type)


def durable_name(component: Column, subscription: Column) -> Column:
    """A name without characters that transports refuse: dots and slashes become underscores."""
    return F.translate(F.concat_ws("-", component, subscription), "./*> ", "_____")


def subject_pattern(pattern: str) -> str:
    """Regular expression of a subject pattern: ``*`` is one token, a final ``>`` one or more."""
    parts = []
    for token in pattern.split("."):
        parts.append(r"[^.]+" if token == "*" else r"[^.]+(?:\.[^.]+)*" if token == ">" else "".join(c if c.isalnum() else "\\" + c for c in token))
    return "^" + r"\.".join(parts) + "$"


def headers(event: dict[str, Column]) -> Column:
    """Envelope headers ``ce-<name>`` of an event's fields; null fields have no header."""
    pairs = [F.struct(F.lit(f"ce-{name}").alias("key"), column.cast("string").alias("value")) for name, column in sorted(event.items())]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def received(sent: Column) -> Column:
    """struct of an event's fields from its ``ce-`` headers: the inverse of ``headers``, with ``problem`` where it has none.

    ``problem``: 'no_id_or_type', or the header that is no integer; numbers without a header are 0.
    """
    def text(name: str) -> Column:
        return F.coalesce(sent[f"ce-{name}"], F.lit(""))

    numbers = {"version": "bigint", "seq": "bigint", "partition": "int", "hops": "int"}
    bad = [F.when(sent[f"ce-{n}"].isNotNull() & (~sent[f"ce-{n}"].rlike("^[+-]?[0-9]+$") | sent[f"ce-{n}"].try_cast("bigint").isNull()), f"ce-{n}") for n in numbers]
    problem = F.coalesce(F.when((text("id") == "") | (text("type") == ""), "no_id_or_type"), *bad)
    texts = [text(n).alias(n) for n in ("id", "type", "source", "subject", "projection", "stream", "epoch", "impl")]
    return F.struct(*texts, *[F.coalesce(sent[f"ce-{n}"].try_cast("bigint"), F.lit(0).cast("bigint")).try_cast(kind).alias(n) for n, kind in numbers.items()], problem.alias("problem"))


def group_key(values: dict[str, Column], at: Column) -> Column:
    """Canonical key of an archive grouping: its declared columns and the UTC month of the anchor."""
    fields = {f"g:{name}": column.cast("string") for name, column in values.items()} | {"period": period(at)}
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def period(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def object_key(prefix: str, unit: Column, generation: Column, version: Column, table: Column) -> Column:
    return F.format_string(f"{prefix}/%s/%d.%d/%s.parquet", unit, generation, version, table)


def backoff_seconds(attempt: Column, first: float, cap: float) -> Column:
    """Doubling waits: ``first`` seconds for attempt 1, never above ``cap``."""
    return F.least(F.lit(float(cap)), F.lit(float(first)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(60)).cast("double")))


def wait_seconds(waited: Column, first: float = 1.0, cap: float = 300.0) -> Column:
    """The next wait of an item that waits: as long as it has waited, within bounds."""
    return F.least(F.lit(cap), F.greatest(F.lit(first), waited))


def title(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def valid_key(key: Column) -> Column:
    """Whether an idempotency key has 1 to 255 visible ASCII characters."""
    return key.rlike(r"^[!-~]{1,255}$")
