"""Canonical forms and digests: equal values have equal bytes, whatever engine wrote them."""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType

from recordloom.functions.decimals import parse_amount_text

# Fixed value: the record type of a request's digest.
REQUEST = "be.idempotency.request"


def canonical_decimal(amount: Column) -> Column:
    """Shortest text of a decimal: no superfluous zeros, no sign of zero. Wide integers keep all their digits."""
    text = F.coalesce(amount.try_cast("decimal(38,18)").cast("string"), amount.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def canonical_instant(at: Column) -> Column:
    """UTC text of an instant with six digits of a second (the session's zone must be UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; ASCII texts pass as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def canonical(column: Column, kind: str) -> Column:
    """The canonical value of a column of a declared archive type: text, but for booleans and lists of texts, which stay
    JSON booleans and arrays. Integers are text, so no reader rounds them. A null stays null."""
    if kind in ("smallint", "int", "bigint", "uuid", "json"):
        text = column.cast("string")
        return F.lower(text) if kind == "uuid" else text
    if kind == "numeric":
        return canonical_decimal(column)
    if kind == "boolean":
        return column.cast("boolean")
    if kind == "timestamp":
        return canonical_instant(column)
    if kind == "date":
        return canonical_date(column)
    if kind == "binary":
        return F.base64(column)
    if kind == "text":
        return nfc(column)
    if kind == "text[]":
        return nfc_all(column)
    raise ValueError(f"no archive type {kind}")


def refused(text: Column, kind: str) -> Column:
    """Whether a text is no canonical value of the type; null if it is null."""
    if kind in ("smallint", "int", "bigint"):
        return text.try_cast(kind).isNull() | ~text.rlike(r"^(0|-?[1-9][0-9]*)$")
    if kind == "numeric":
        return parse_amount_text(text).isNull()
    if kind == "uuid":
        return ~text.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    if kind == "timestamp":
        return text.try_cast("timestamp").isNull() | ~text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$")
    if kind == "date":
        return text.try_cast("date").isNull() | ~text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    if kind == "binary":
        return ~text.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    if kind in ("text", "json"):
        return F.when(text.isNotNull(), F.lit(False))
    raise ValueError(f"no text form of {kind}")


def from_canonical(text: Column, kind: str) -> Column:
    """The value of a canonical text: the inverse of ``canonical`` for types with a text form; null where it is refused."""
    if kind == "numeric":
        return parse_amount_text(text)
    good = F.when(~refused(text, kind), text)
    if kind == "binary":
        return F.unbase64(good)
    return good if kind in ("text", "json", "uuid") else good.try_cast(kind)


@pandas_udf(ArrayType(StringType()))
def nfc_all(texts: pd.Series) -> pd.Series:
    """Unicode composition of every text of a list."""
    return texts.map(lambda ts: ts if ts is None else [t if t is None else unicodedata.normalize("NFC", t) for t in ts])


def small_escapes(json: Column) -> Column:
    """JSON text with escaped control characters in small letters, as the canonical encoding has them; Spark writes capitals."""
    out = json
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # the others have no letter, or an escape of their own
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(json.contains("\\u00"), out).otherwise(json)


def canonical_object(fields: dict[str, Column]) -> Column:
    """JSON text of an object: keys in order, null members left out."""
    return small_escapes(F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)])))


def canonical_text(text: Column) -> Column:
    """JSON text of one string."""
    whole = small_escapes(F.to_json(F.array(text)))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def canonical_set(texts: Column) -> Column:
    """JSON array of a set of strings: without repeats, in the order of their encoded bytes. Nulls are left out."""
    encoded = F.transform(F.array_distinct(F.array_compact(texts)), canonical_text)
    return F.concat(F.lit("["), F.array_join(F.array_sort(encoded), ","), F.lit("]"))


def canonical_key(parts: list[Column]) -> Column:
    """JSON array of a primary key's canonical values; null if any part is null."""
    whole = small_escapes(F.to_json(F.array(*parts)))
    for part in parts:
        whole = F.when(part.isNotNull(), whole)
    return whole


def domain_digest(record_type: str, version: int, body: Column) -> Column:
    """SHA-256 of a canonical body under its record type, so that equal bodies of two types differ."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{record_type}.v{version}\n"), body), 256))


def request_fingerprint(principal: Column, operation: Column, target: Column, body: Column) -> Column:
    """Digest of a request: two requests under one idempotency key are the same if it is equal."""
    fields = {"principal": nfc(principal), "operation": nfc(operation), "target": nfc(target), "body_sha256": F.sha2(body.cast("binary"), 256)}
    return domain_digest(REQUEST, 1, canonical_object(fields))


def row_digest(event_id: Column, payload: Column) -> Column:
    """SHA-256 of an event's id, a zero byte and its payload (binary or text)."""
    return F.sha2(F.concat(F.encode(event_id, "UTF-8"), F.lit(b"\0"), payload.cast("binary")), 256)


def length_prefixed(text: Column) -> Column:
    """Eight bytes of the length in bytes, then the bytes."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), raw)


def table_hash(rows: DataFrame, group: list[str], key: str, row: str) -> DataFrame:
    """``group, rows, sha256``: hash of each group's rows in the order of their key's bytes, as given in any order.

    A group's rows are sorted on Spark, where they may spill, and stream through one hash; no group is held as a whole.
    """
    names = [f"_g{k}" for k in range(len(group))]
    told = rows.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.encode(key, "UTF-8").alias("_k"), length_prefixed(F.col(row)).alias("_r"))
    kept = ", ".join(f"`{g}` {told.schema[n].dataType.simpleString()}" for g, n in zip(group, names, strict=True))
    target = told.select(*[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], F.lit(0).cast("long").alias("rows"), F.lit("").alias("sha256")).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(target)
        current, count, running = None, 0, hashlib.sha256()
        done: list[tuple] = []

        def leave() -> pa.RecordBatch:
            columns = [pa.array([d[k] for d in done], field.type) for k, field in enumerate(schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            groups = zip(*[batch.column(k).to_pylist() for k in range(len(names))], strict=True)
            for mine, run in itertools.groupby(zip(groups, batch.column(len(names) + 1).to_pylist(), strict=True), key=lambda x: x[0]):
                if mine != current:
                    if current is not None:
                        done.append((*current, count, running.hexdigest()))
                    current, count, running = mine, 0, hashlib.sha256()
                for _, raw in run:
                    count += 1
                    running.update(raw or b"")
            if len(done) >= 10_000:
                yield leave()
        if current is not None:
            done.append((*current, count, running.hexdigest()))
        if done:
            yield leave()

    return told.repartition(*names).sortWithinPartitions(*names, "_k", "_r").mapInArrow(hashed, f"{kept}, rows long, sha256 string")


def unit_digest(sums: DataFrame, group: list[str], record_class: str, schema_version: str) -> DataFrame:
    """``group, digest`` over a unit's tables (``name, rows, sha256``), in order of their names."""
    tables = F.array_sort(F.collect_list(F.struct("name", F.col("rows").cast("string").alias("rows"), "sha256")))
    body = F.to_json(F.struct(F.lit(record_class).alias("class"), F.lit(schema_version).alias("schema_version"), tables.alias("tables")))
    return sums.groupBy(*group).agg(domain_digest("record.unit", 1, body).alias("digest"))
