"""Canonical JSON of values of any shape, and the sealed records that rest on it.

The encoding has members in order, the fewest escapes, integers below 2^53, and neither nulls nor fractions. A value of
unknown shape is walked once, in Arrow batches; records whose shape is declared are built from columns.
"""

from __future__ import annotations

import json
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from recordloom.functions.canonical import canonical_object, canonical_set, canonical_text, domain_digest

# The least integer that is refused, the types of records, and the phases that are replayed.
WIDE = 1 << 53
DEFINITION, DEFINITION_SET, AUDIT, EVIDENCE = "be.security.definition", "be.security.definition_set", "be.audit.record", "be.evidence.record"
REPLAYED = ("effective", "general", "intent")

ENCODED = StructType([StructField("body", StringType()), StructField("refusal", StringType())])


class Refused(ValueError):
    """A value that the canonical encoding has no form of."""


def _integer(text: str) -> int:
    number = int(text)
    if abs(number) >= WIDE:
        raise Refused("wide_integer")
    return number


def _fraction(text: str) -> float:
    raise Refused("fraction")


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Refused("duplicate_name")
    return found


def _without_nulls(value: Any) -> Any:
    """Null members of objects at any depth are left out; null elements stay, and are refused later."""
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def _composed(value: Any) -> Any:
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dict):
        return {_composed(k): _composed(v) for k, v in value.items()}
    return [_composed(v) for v in value] if isinstance(value, list) else value


def _no_null(value: Any) -> None:
    if value is None:
        raise Refused("null")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _no_null(v)


def _encoded(text: str | None, drop_nulls: bool, compose: bool) -> tuple[str | None, str | None]:
    if text is None:
        return None, None
    try:
        value = json.loads(text, object_pairs_hook=_members, parse_int=_integer, parse_float=_fraction, parse_constant=_fraction)
        value = _without_nulls(value) if drop_nulls else value
        _no_null(value)
        return json.dumps(_composed(value) if compose else value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None
    except Refused as why:
        return None, str(why)
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "not_json"


@pandas_udf(ENCODED)
def _plain(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_encoded(t, False, False) for t in text], columns=["body", "refusal"])


@pandas_udf(ENCODED)
def _dropping(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_encoded(t, True, False) for t in text], columns=["body", "refusal"])


@pandas_udf(ENCODED)
def _composing(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_encoded(t, False, True) for t in text], columns=["body", "refusal"])


def canonical_json(text: Column, drop_nulls: bool = False) -> Column:
    """struct(body, refusal) of a JSON text: its canonical form, or why it has none: 'not_json' (also data after the value),
    'null', 'fraction', 'wide_integer' (from 2^53), 'duplicate_name', 'too_deep' (about 1 000 levels). ``drop_nulls`` leaves null
    members of objects out first. Members are ordered by their code points, which is the order of their bytes. A null text
    has neither body nor refusal."""
    return (_dropping if drop_nulls else _plain)(text)


def is_canonical(text: Column) -> Column:
    """Whether a text is the canonical form, in composed Unicode, of what it says; null if it is null."""
    return F.when(text.isNotNull(), F.coalesce(_composing(text)["body"] == text, F.lit(False)))


def sealed(record_type: str, body: Column) -> Column:
    """struct(raw, digest, refusal) of a record's JSON text."""
    told = canonical_json(body)
    return F.struct(told["body"].alias("raw"), domain_digest(record_type, 1, told["body"]).alias("digest"), told["refusal"].alias("refusal"))


def opened(rows: DataFrame, record_type: str) -> DataFrame:
    """``rows`` (raw, digest) with ``problem``: null for a record that is canonical, an object, has its digest and asks for no
    feature; else 'not_canonical', 'digest', 'not_an_object' or 'feature'."""
    features = F.from_json(F.get_json_object("raw", "$.required_features"), "array<string>")
    problem = (
        F.when(~F.coalesce(is_canonical(F.col("raw")), F.lit(False)), "not_canonical")
        .when(~F.coalesce(domain_digest(record_type, 1, F.col("raw")) == F.col("digest"), F.lit(False)), "digest")
        .when(~F.col("raw").startswith("{"), "not_an_object").when(F.coalesce(F.size(features), F.lit(0)) > 0, "feature")
    )
    return rows.withColumn("problem", problem)


def stable_id(*parts: Column) -> Column:
    """A UUID of the parts' hash, the same in every version and deployment."""
    h = F.sha2(F.concat_ws("\n", F.lit(DEFINITION), *parts), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("7"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *pieces)


def raw_object(members: dict[str, Column]) -> Column:
    """JSON text of an object whose members are JSON texts already; null ones are left out."""
    told = [F.concat(canonical_text(F.lit(name)), F.lit(":"), members[name]) for name in sorted(members)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*told)), ","), F.lit("}"))


def object_of(names: Column, bodies: Column) -> Column:
    """JSON text of an object from an array of names and one of JSON texts, in the order of the names."""
    told = F.array_sort(F.arrays_zip(names.alias("name"), bodies.alias("body")))
    return F.concat(F.lit("{"), F.array_join(F.transform(told, lambda m: F.concat(canonical_text(m["name"]), F.lit(":"), m["body"])), ","), F.lit("}"))


def definition_records(definitions: DataFrame, record_type: str, kind: str, deployment: str, version: str) -> DataFrame:
    """``component, key, raw, digest`` of definitions (component, key, members: map of names to JSON texts), each in the
    envelope of a record: the component is the authority, its version the revision."""
    domain = F.concat(F.translate("component", "/-", "._"), F.lit(".definition"))
    envelope = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("authority", "deployment", "id", "record_type", "revision", "schema")]),
        F.array(canonical_text(F.col("component")), canonical_text(F.lit(deployment)), canonical_text(stable_id(F.col("component"), F.lit(kind), F.col("key"))),
                canonical_text(F.lit(record_type)), raw_object({"domain": canonical_text(domain), "value": canonical_text(F.lit(version))}), F.lit('"1.0"')),
    )
    whole = F.map_concat(envelope, F.col("members"))
    raw = object_of(F.map_keys(whole), F.map_values(whole))
    return definitions.select("component", "key", raw.alias("raw")).withColumn("digest", domain_digest(record_type, 1, F.col("raw")))


def definition_sets(records: DataFrame, version: str) -> DataFrame:
    """``component, definitions, digest``: the digest of each component's set of definitions (component, digest)."""
    sets = records.groupBy("component").agg(F.collect_set("digest").alias("d"))
    body = raw_object({"component": canonical_text(F.col("component")), "version": canonical_text(F.lit(version)), "definitions": canonical_set(F.col("d"))})
    return sets.select("component", F.size("d").alias("definitions"), domain_digest(DEFINITION_SET, 1, body).alias("digest"))


def candidate_digest(record_type: Column, candidate: Column) -> Column:
    """struct(digest, refusal) of a change request's candidate: its canonical form under its record type; only objects."""
    told = canonical_json(candidate)
    refusal = F.coalesce(told["refusal"], F.when(~told["body"].startswith("{"), "not_an_object"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("be.security."), record_type, F.lit(".v1\n"), told["body"]), 256))
    return F.struct(F.when(refusal.isNull(), digest).alias("digest"), refusal.alias("refusal"))


def object_version(after: Column) -> Column:
    """The version that a JSON object of a changed record names: an integer of 64 bits, else null."""
    text = F.get_json_object(after, "$.version")
    return F.when(text.rlike("^-?[0-9]+$"), text).try_cast("long")


def audit_records(rows: DataFrame) -> DataFrame:
    """``rows`` with ``raw, digest, refusal`` of their audit record.

    Columns: id, occurred_at (canonical text), category, operation, outcome; reason, actor and represented may be null or
    empty and are left out then; target, changes and request are JSON texts whose null members are left out at any depth.
    """
    texts = {n: canonical_text(F.col(n)) for n in ("id", "occurred_at", "category", "operation", "outcome")}
    texts |= {n: F.when(F.col(n) != "", canonical_text(F.col(n))) for n in ("reason", "actor", "represented")}
    parts = {n: canonical_json(F.col(n), drop_nulls=True) for n in ("target", "changes", "request")}
    told = rows.select("*", *[x.alias(f"_{n}") for n, x in parts.items()])
    refusal = F.coalesce(*[F.col(f"_{n}.refusal") for n in parts])
    raw = F.when(refusal.isNull(), raw_object(texts | {n: F.col(f"_{n}.body") for n in parts}))
    told = told.withColumn("raw", raw).withColumn("digest", domain_digest(AUDIT, 1, F.col("raw"))).withColumn("refusal", refusal)
    return told.drop(*[f"_{n}" for n in parts])


def receipts_judged(reads: DataFrame, receipts: DataFrame) -> DataFrame:
    """``id, outcome`` of reads (id, operation, strict): a strict read is 'released' with exactly one receipt of status 'received',
    else 'refused'; other reads are released. ``receipts``: id, status."""
    known = receipts.groupBy("id").agg(F.count("*").alias("_n"), F.first("status").alias("_status"))
    good = (F.col("_n") == 1) & (F.col("_status") == "received")
    return reads.join(known, "id", "left").select("id", F.when(~F.col("strict") | F.coalesce(good, F.lit(False)), "released").otherwise("refused").alias("outcome"))


def replayed(rows: DataFrame, component: str) -> DataFrame:
    """``rows`` (raw) with what a recovery replays of them, or ``problem``: 'not_json', 'not_a_record', 'other_component',
    'phase' or 'time'."""
    fields = "record_type string, id string, recorder struct<component:string>, category string, phase string, subject string, object struct<type:string,id:string,version:string>, at string"
    read = rows.withColumn("_r", F.from_json("raw", fields)).withColumn("_json", F.try_parse_json("raw").isNotNull())
    r = F.col
    at = F.when(r("_r.at").rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), r("_r.at").try_cast("timestamp"))
    problem = (
        F.when(~r("_json"), "not_json").when(~F.coalesce((r("_r.record_type") == EVIDENCE) & (r("_r.id") != ""), F.lit(False)), "not_a_record")
        .when(~F.coalesce(r("_r.recorder.component") == component, F.lit(False)), "other_component").when(~F.coalesce(r("_r.phase").isin(*REPLAYED), F.lit(False)), "phase").when(at.isNull(), "time")
    )
    told = read.withColumn("problem", problem)
    names = {"id": r("_r.id"), "category": r("_r.category"), "phase": r("_r.phase"), "subject": r("_r.subject"), "object_type": r("_r.object.type"), "object_id": r("_r.object.id"), "object_version": r("_r.object.version"), "at": at}
    return told.select(*rows.columns, *[F.when(r("problem").isNull(), x).alias(n) for n, x in names.items()], "problem")
