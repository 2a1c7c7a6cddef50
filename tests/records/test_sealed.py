"""Canonical JSON and sealed records: shapes, refusals and vectors."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from recordloom.functions import canonical, records


def encoded(spark, texts, drop_nulls=False):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("c", records.canonical_json(F.col("t"), drop_nulls))
    return [(r.c.body, r.c.refusal) for r in df.orderBy("k").collect()]


def test_canonical_json_of_nested_values(spark):
    cases = {
        '{"b": 1, "a": {"d": [true, {"z": "x", "y": false}], "c": "é"}}': '{"a":{"c":"é","d":[true,{"y":false,"z":"x"}]},"b":1}',
        ' [ ] ': "[]", '{}': "{}", '"\\u0041\\/\\u2028"': '"A/\u2028"', "-0": "0", "9007199254740991": "9007199254740991", "true": "true",
        '{"é": 1, "z": 2, "": 3, "\U0001f600": 4, "\uffee": 5}': '{"":3,"z":2,"é":1,"\uffee":5,"\U0001f600":4}',
    }
    assert encoded(spark, list(cases)) == [(want, None) for want in cases.values()]


def test_canonical_json_refuses(spark):
    cases = {
        "null": "null", "[null]": "null", '{"a": null}': "null", "1.0": "fraction", "[1e2]": "fraction", '{"a": NaN}': "fraction", "9007199254740992": "wide_integer", "[-9007199254740992]": "wide_integer",
        '{"a": 1, "a": 1}': "duplicate_name", '{"x": {"a": 1, "b": 2, "a": 3}}': "duplicate_name", "": "not_json", "{": "not_json", "1 2": "not_json", "{'a': 1}": "not_json", "[" * 100_000: "too_deep",
    }
    assert encoded(spark, [*cases, None]) == [*((None, why) for why in cases.values()), (None, None)]


def test_null_members_are_dropped_at_every_depth(spark):
    assert encoded(spark, ['{"a": null, "b": {"c": null, "d": [{"e": null, "f": 1}]}}', '{"a": [null]}'], True) == [('{"b":{"d":[{"f":1}]}}', None), (None, "null")]


def test_every_control_character_has_the_encodings_escape(spark):
    codes = [*range(0x20), 0x7F, 0x80, 0x2028]
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    wanted = ['{"a":"' + (short.get(c) or (f"\\u{c:04x}" if c < 0x20 else chr(c))) + '"}' for c in codes]
    df = spark.createDataFrame([(k, chr(c)) for k, c in enumerate(codes)], "k long, t string")
    assert [r.x for r in df.orderBy("k").select(canonical.canonical_object({"a": F.col("t")}).alias("x")).collect()] == wanted
    assert [r.x for r in df.orderBy("k").select(records.raw_object({"a": canonical.canonical_text(F.col("t"))}).alias("x")).collect()] == wanted
    assert [body for body, _ in encoded(spark, [json.dumps({"a": chr(c)}) for c in codes])] == wanted


def test_escapes_that_only_look_like_control_characters_stay(spark):
    texts = ["\\u001F", "\\\\u001F", "\x1f\x1f", "\\\x1f", '"\x0b"', "\\u001F\x1a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").orderBy("k")
    assert [r.x for r in df.select(canonical.canonical_text(F.col("t")).alias("x")).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_canonical_bytes_are_told(spark):
    cases = [('{"a":1}', True), ('{"a": 1}', False), ('{"b":1,"a":1}', False), ('"\\u0041"', False), ('"e\u0301"', False), ('"\u00e9"', True), ('{"e\u0301":1}', False), ("[1.0]", False), ("nope", False), ('"\\u001f"', True), ('"\\u001F"', False), (None, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, t string").orderBy("k")
    assert [r.x for r in df.select(records.is_canonical(F.col("t")).alias("x")).collect()] == [want for _, want in cases]


def test_sets_are_ordered_by_their_encoded_bytes(spark):
    texts = ["b", "a", "b", '"', "\x1f", "é", None, "\U0001f600", "\uffee", ""]
    found = spark.range(1).select(canonical.canonical_set(F.array(*[F.lit(t) for t in texts])).alias("x")).first().x
    wanted = sorted({json.dumps(t, ensure_ascii=False) for t in texts if t is not None}, key=lambda x: x.encode())
    assert found == "[" + ",".join(wanted) + "]"


def test_stable_ids_are_uuids_of_the_parts(spark):
    found = spark.range(1).select(records.stable_id(F.lit("shop/a-b"), F.lit("resource"), F.lit("invoice")).alias("x")).first().x
    raw = bytearray(hashlib.sha256(b"be.security.definition\nshop/a-b\nresource\ninvoice").digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x70, raw[8] & 0x3F | 0x80
    assert found == str(uuid.UUID(bytes=bytes(raw))) and uuid.UUID(found).version == 7


def test_opened_records_have_their_digest_and_no_unknown_feature(spark):
    good = '{"a":1}'
    digest = lambda raw: "sha256:" + hashlib.sha256(b"be.x.v1\n" + raw.encode()).hexdigest()
    feature, empty = '{"required_features":["new"]}', '{"required_features":[]}'
    cases = [(good, digest(good), None), (good, digest(good + " "), "digest"), ('{"a": 1}', digest('{"a": 1}'), "not_canonical"), ("[1]", digest("[1]"), "not_an_object"), (feature, digest(feature), "feature"), (empty, digest(empty), None), (None, "x", "not_canonical"), (good, None, "digest")]
    df = spark.createDataFrame([(k, r, d) for k, (r, d, _) in enumerate(cases)], "k long, raw string, digest string")
    assert [r.problem for r in records.opened(df, "be.x").orderBy("k").collect()] == [why for _, _, why in cases]


@pytest.mark.parametrize(("after", "want"), [('{"version": 7}', 7), ('{"version": 7.5}', None), ('{"version": "8"}', 8), ("{}", None), ("x", None), (None, None), ('{"version": 9223372036854775808}', None)])
def test_versions_of_changed_objects(spark, after, want):
    assert spark.range(1).select(records.object_version(F.lit(after)).alias("x")).first().x == want
