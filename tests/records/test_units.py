"""Rules that tables can't show: refusals, daylight saving, cursors, files and streams."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordloom.functions import calendar, canonical, decimals, keys, search
from recordloom.operators import decisions, folds, listing, policy, relations
from recordloom.plans import archive
from recordloom.plans.queries import RESOURCE, SEGMENTS, items, listed, view_plan
from recordloom.sources import archive as files
from recordloom.sources.tables import SchemaMismatch, assert_schema
from recordloom.streaming import inbox, projection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_amounts(spark):
    cases = {"0": "0.00", "-0": None, "01": None, "1.5": "1.50", "1.234": None, "1.230": "1.23", "1e3": None, "+1": None, "-12.34": "-12.34", ".5": None, "5.": None, "9" * 39: None}
    for text, want in cases.items():
        got = one(spark, decimals.parse_amount(F.lit(text), 2))
        assert (None if got is None else str(got)) == want, text
    for value, mode, want in (("2.5", "half_away", 3), ("-2.5", "half_away", -3), ("2.5", "half_even", 2), ("3.5", "half_even", 4), ("-2.5", "half_even", -2)):
        assert int(one(spark, decimals.round_amount(F.lit(value).cast("decimal(10,1)"), 0, mode))) == want
    for units, multiple, want in ((7, 5, 5), (8, 5, 10), (-8, 5, -10), (25, 50, 50), (-25, 50, -50), ((1 << 62) + 1, 5, 4611686018427387905)):
        assert one(spark, decimals.round_units(F.lit(units).cast("long"), multiple)) == want
    with pytest.raises(ValueError):
        decimals.round_units(F.lit(1), 0)


def test_allocation_sums_and_signs(spark):
    rnd = random.Random(2)
    rows, totals = [], {}
    for g in range(40):
        total = rnd.choice([100, -100, 0, rnd.randint(-10**12, 10**12)])
        totals[g] = total
        rows += [(g, i, total, w) for i, w in enumerate([1, 1, 1] if g == 0 else [rnd.randint(0, 50) for _ in range(rnd.randint(1, 7))] + [1])]
    rows.append((99, 0, 5, 0))
    df = spark.createDataFrame(rows, "g long, i long, total long, w long")
    parts = decimals.allocate(df, ["g"], "total", "w", ["i"]).orderBy("g", "i").collect()
    for g, total in totals.items():
        own = [r for r in parts if r.g == g]
        assert sum(r.part for r in own) == total
        weights = sum(r.w for r in own)
        assert all(abs(r.part - total * r.w / weights) < 1 for r in own)
    assert [r.part for r in parts if r.g == 99] == [None]
    hundred = spark.createDataFrame([(0, i, 100, 1) for i in range(3)], "g long, i long, total long, w long")
    assert [r.part for r in decimals.allocate(hundred, ["g"], "total", "w", ["i"]).orderBy("i").collect()] == [34, 33, 33]


def test_canonical_forms(spark):
    for text, want in (("100", "100"), ("100.500", "100.5"), ("0.000", "0"), ("-1.20", "-1.2"), ("10", "10")):
        assert one(spark, canonical.canonical_decimal(F.lit(text).cast("decimal(38,18)"))) == want
    assert one(spark, canonical.canonical_decimal(F.lit(100).cast("decimal(10,0)"))) == "100"
    assert one(spark, canonical.nfc(F.lit("é"))) == "é"
    body = canonical.canonical_object({"b": F.lit("x"), "a": F.lit(1), "n": F.lit(None).cast("string")})
    assert one(spark, body) == '{"a":1,"b":"x"}'
    assert one(spark, canonical.canonical_key([F.lit("a"), F.lit(None).cast("string")])) is None


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = [("u", json.dumps([str(i)]), json.dumps({"v": "é" * i})) for i in range(50)]
    expected = None
    for n in (1, 7):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, "unit string, pk string, row string").repartition(n)
        got = canonical.table_hash(df, ["unit"], "pk", "row").collect()
        expected = expected or got
        assert got == expected
    import hashlib

    h = hashlib.sha256()
    for _, _, row in sorted(rows, key=lambda r: r[1].encode()):
        raw = row.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    assert expected[0].sha256 == h.hexdigest()


def test_hashes_of_many_units_stream_by_their_rows(spark):
    import hashlib

    rows = [(None if u == 0 else u, str(u % 3), f"k{i * 7 % 11}", f"{u}-{i}") for u in range(40) for i in range(u % 5 + 1)]
    df = spark.createDataFrame(rows, "unit long, part string, pk string, row string").repartition(5)
    want = {}
    for u, part, _, row in sorted(rows, key=lambda r: (r[2].encode(), r[3])):
        n, h = want.setdefault((u, part), [0, hashlib.sha256()])
        h.update(len(row).to_bytes(8, "big") + row.encode())
        want[u, part][0] = n + 1
    got = {(r.unit, r.part): (r.rows, r.sha256) for r in canonical.table_hash(df, ["unit", "part"], "pk", "row").collect()}
    assert got == {k: (n, h.hexdigest()) for k, (n, h) in want.items()}
    assert canonical.table_hash(df.where("false"), ["unit"], "pk", "row").collect() == []


def test_streamed_numbers_go_on_within_an_epoch(spark, tmp_path):
    from recordloom.streaming import outbox

    schema = "partition int, epoch string, ord long"
    batches = [[(p, "e1", k) for p in (0, 1) for k in range(3)], [(0, "e1", 3), (0, "e2", 4), (0, "e2", 5), (1, "e2", 3)], [(0, "e2", 6), (0, "e1", 7), (0, "e2", 8)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out = outbox.numbered_stream(stream, f"{schema}, seq long").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.partition, r.ord): (r.epoch, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want, counters = {}, {}
    for p, epoch, ord_ in (r for rows in batches for r in rows):
        last = counters.get(p, (None, 0))
        counters[p] = (epoch, last[1] + 1 if last[0] == epoch else 1)
        want[p, ord_] = counters[p]
    assert got == want


def fnv(text, n):
    h = 14695981039346656037
    for b in text.lower().encode():
        h = ((h ^ b) * 1099511628211) % (1 << 64)
    return h % n


def test_partitions(spark):
    texts = ["", "A", "Straße", "x" * 300, "0190a3f2-7b1c-7def-8abc-0123456789AB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 7, 256):
        assert [r.p for r in df.select(keys.partition_of(F.col("t"), n).alias("p")).collect()] == [fnv(t, n) for t in texts]


def test_subjects_epochs_headers(spark):
    import re

    for pattern, good, bad in (("a.*.c", ["a.b.c"], ["a.c", "a.b.b.c"]), ("a.>", ["a.b", "a.b.c"], ["a", "b.a"]), ("*", ["a"], ["a.b"])):
        assert all(re.search(keys.subject_pattern(pattern), g) for g in good) and not any(re.search(keys.subject_pattern(pattern), b) for b in bad)
    assert one(spark, keys.epoch_of(F.lit("10.2")) > keys.epoch_of(F.lit("9.99"))) is True
    assert one(spark, keys.epoch_of(F.lit("x.2"))) is None
    assert one(spark, keys.headers({"id": F.lit(1), "type": F.lit(None).cast("string")})) == {"ce-id": "1"}


def test_time_tables_and_daylight_saving(spark):
    t = calendar.parse_time_table("*/20 1-3,5 1 */6 0,7")
    assert t.minutes == (0, 20, 40) and t.hours == (1, 2, 3, 5) and t.months == (1, 7) and t.weekdays == (0,) and t.either_day
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            calendar.parse_time_table(bad)

    def at(expression, zone, after, until):
        return [(r.slot, str(r["at"])) for r in calendar.slots(spark, expression, zone, after, until).orderBy("at").collect()]

    # 02:30 does not exist on 10 March 2024 in New York: the first moment after the jump
    assert at("30 2 * * *", "America/New_York", "2024-03-09 12:00:00", "2024-03-11 12:00:00") == [("2024-03-10T02:30", "2024-03-10 07:00:00"), ("2024-03-11T02:30", "2024-03-11 06:30:00")]
    # 01:30 occurs twice on 3 November: the first occurrence
    assert at("30 1 * * *", "America/New_York", "2024-11-03 00:00:00", "2024-11-04 00:00:00") == [("2024-11-03T01:30", "2024-11-03 05:30:00")]
    # half-hour change
    assert at("15 2 * * *", "Australia/Lord_Howe", "2024-10-05 00:00:00", "2024-10-06 00:00:00") == [("2024-10-06T02:15", "2024-10-05 15:30:00")]
    due = calendar.slots(spark, "0 * * * *", "UTC", "2024-01-01 00:00:00", "2024-01-02 06:00:00")
    assert [r.state for r in calendar.backfill(due, "all", "2024-01-02 06:00:00").orderBy("at").collect()] == ["pending"] * 24 + ["paused"] * 6
    assert [r.slot for r in calendar.backfill(due, "latest", "2024-01-02 06:00:00").collect()] == ["2024-01-02T06:00"]
    assert calendar.backfill(due, "none", "2024-01-02 06:00:30").count() == 1
    with pytest.raises(ValueError):
        calendar.business_date(F.lit(None), "Local")


def test_search_forms(spark):
    assert search.fold_text("ＡＢ​\tc") == "abc"
    text = one(spark, search.search_text({"山": "shan", "东": "dong"}, F.lit("山东 A"), F.lit(None).cast("string")))
    assert text.split(search.UNIT) == ["山东 a", "shandong a", "sd a"]
    assert one(spark, search.matches(F.lit("50% off"), " 50% ")) is True
    assert one(spark, search.matches(F.lit("500 off"), "50%")) is False


# --- policies and lists -----------------------------------------------------------------------------------------


def in_memory(row, s):
    """A segment on one row in plain Python."""
    for name, a in s.atoms.items():
        d = RESOURCE.dimensions[name]
        v = row[d.column]
        if a.kind == "all":
            continue
        if a.kind == "in" and v not in a.values or a.kind == "self" and v != "Customer#000000007":
            return False
        if a.kind == "tree" and not any(v == p or (below and v.startswith(p + "/")) for p, below in a.items):
            return False
        if a.kind == "interval":
            if row[d.currency_column] != a.currency or v is None:
                return False
            if a.low is not None and (v < int(a.low) or v == int(a.low) and not a.low_closed):
                return False
            if a.high is not None and (v > int(a.high) or v == int(a.high) and not a.high_closed):
                return False
    return True


@pytest.mark.parametrize("operation", ["view", "export"])
def test_compiled_plan_equals_evaluation_row_by_row(spark, small, operation):
    plan = view_plan(operation)
    now = datetime.datetime(2001, 9, 1, tzinfo=datetime.UTC)
    rows = items(spark, small)
    got = {r.order_id: r.readable for r in rows.where(plan.where).select("order_id", plan.readable().alias("readable")).collect()}
    wanted = {}
    for r in rows.collect():
        view = [s for s in SEGMENTS if s.operation == "view" and s.active_at(now) and in_memory(r, s)]
        own = view if operation == "view" else [s for s in SEGMENTS if s.operation == "export" and in_memory(r, s)]
        if view and own:
            wanted[r.order_id] = sorted({f for s in own for f in s.read_fields if RESOURCE.fields[f] != policy.SECRET})
    assert got == wanted and wanted


def test_the_predicate_reaches_the_scan(spark, small):
    page = listing.build(
        listing.Spec({"k": listing.Listed("o_custkey", "long")}, "o_orderkey", "long"),
        policy.compile_plan(policy.Resource({"p": policy.Dimension("o_orderpriority")}, {"k": policy.ORDINARY}), [policy.Segment("view", {"p": policy.Atom("in", values=("1-URGENT",))}, ("k",), "2000-01-01T00:00:00+00:00")], "view", "x", datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)),
        listing.Request(sort=(("k", True),)),
    )
    plan = page.rows(spark.read.parquet(f"{small}/orders.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_orderpriority, [1-URGENT])" in plan or "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_refusals_of_lists(spark):
    spec, plan = listed(), view_plan()
    for request in (
        listing.Request(limit=0), listing.Request(limit=201), listing.Request(sort=(("path", False),)), listing.Request(sort=(("cents", False),)),
        listing.Request(filters=(listing.Filter("cents", "eq", ("1",)),)), listing.Request(filters=(listing.Filter("day", "eq", ()),)), listing.Request(filters=(listing.Filter("day", "like", ("x",)),)), listing.Request(readable_only=("status",)),
    ):
        with pytest.raises(listing.BadRequest):
            listing.build(spec, plan, request)
    first = listing.build(spec, plan, listing.Request(sort=(("day", True),)))
    cursor = first.next_cursor({"day": "1999-01-01", "order_id": 7})
    listing.build(spec, plan, listing.Request(sort=(("day", True),), cursor=cursor))
    with pytest.raises(listing.CursorInvalid):
        listing.build(spec, plan, listing.Request(sort=(("day", False),), cursor=cursor))
    with pytest.raises(listing.CursorInvalid):
        listing.build(spec, plan, listing.Request(cursor="!!"))
    with pytest.raises(listing.PlanChanged):
        listing.build(spec, view_plan("export"), listing.Request(sort=(("day", True),), cursor=cursor))


def test_pages_walk_the_whole_list(spark, small):
    plan, rows = view_plan(), items(spark, small).persist()
    seen, cursor = [], None
    for _ in range(100):
        page = listing.build(listed(), plan, listing.Request(sort=(("segment", True), ("day", False)), limit=200, cursor=cursor))
        got = [r.asDict() for r in page.rows(rows).collect()]
        seen += [r["order_id"] for r in got[:200]]
        if len(got) <= 200:
            break
        cursor = page.next_cursor(got[199])
    assert sorted(seen) == sorted(r.order_id for r in rows.where(plan.where).select("order_id").collect())
    assert len(seen) == len(set(seen))
    rows.unpersist()


def test_not_pushable_dimension_is_refused():
    resource = policy.Resource({"x": policy.Dimension("x", pushable=False)}, {})
    s = policy.Segment("view", {"x": policy.Atom("in", values=("a",))}, (), "2000-01-01T00:00:00+00:00")
    with pytest.raises(policy.NotCompletable):
        policy.compile_plan(resource, [s], "view", "p", datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))


# --- folds and projections --------------------------------------------------------------------------------------


def test_order_of_whole_inputs_does_not_matter(spark):
    rnd = random.Random(4)
    rows = [(str(rnd.randint(0, 9)), rnd.choice(["full", "delete"]), v, "i", "1.0", None, v) for v in rnd.sample(range(1000), 200)]
    schema = "record_id string, kind string, version long, impl string, epoch string, data string, seq long"
    whole = {(r.record_id, r.state, r.version) for r in projection.fold_whole(spark.createDataFrame(rows, schema), ["record_id"]).collect()}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        shuffled = [(*r[:6], k) for k, r in enumerate(rows)]
        ordered = projection.fold_ordered(spark.createDataFrame(shuffled, schema), ["seq"]).collect()
        assert {(r.record_id, r.state, r.version) for r in ordered} == whole


def test_record_fold_follows_the_decision_table(spark):
    """Every state and input of the table, once by the column and once by the fold."""
    schema = "state string, version long, need long, old boolean, kind string, v long"
    states = [(None, None, None), ("complete", 3, None), ("incomplete", 3, 3), ("tombstone", 3, None)]
    rows = [(*s, old, kind, v) for s, old, kind, v in itertools.product(states, [False, True], ["full", "partial", "delete", "purged"], [2, 3, 4]) if s[0] or not old]
    out = decisions.projection_row(*[F.col(c) for c in ("state", "version", "need", "old", "kind", "v")])
    for r in spark.createDataFrame(rows, schema).select("*", out.alias("o")).collect():
        row = None if r.state is None else {"state": r.state, "version": r.version, "need_version": r.need, "impl": "i0" if r.old else "i", "epoch": "1.0", "data": "{}"}
        after = projection.fold_record(row, iter([{"kind": r.kind, "version": r.v, "impl": "i", "epoch": "1.0", "data": "{}"}]))
        assert (after["state"], after["version"], after["need_version"]) == (r.o.state, r.o.version, r.o.need_version), r


def test_partial_inputs_merge_and_wait_for_a_fetch():
    steps = [{"kind": "full", "version": 1, "data": '{"a": 1, "b": 1}'}, {"kind": "partial", "version": 3, "data": '{"b": 2, "c": 3}'}, {"kind": "full", "version": 2, "data": "{}"}]
    row = projection.fold_record(None, iter([s | {"impl": "i", "epoch": "1.0"} for s in steps]))
    assert row["state"] == "incomplete" and row["need_version"] == 3 and json.loads(row["data"]) == {"a": 1, "b": 2, "c": 3}
    row = projection.fold_record(row, iter([{"kind": "full", "version": 3, "data": '{"a": 9}', "impl": "i", "epoch": "1.0"}]))
    assert row["state"] == "complete" and row["data"] == '{"a": 9}'


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    rnd = random.Random(8)
    schema = "record_id string, kind string, version long, impl string, epoch string, data string, seq long"
    rows = [(str(rnd.randint(0, 5)), rnd.choice(["full", "partial", "delete"]), rnd.randint(0, 60), "i", "1.0", json.dumps({rnd.choice("abc"): k}), k) for k in range(120)]
    for part in range(4):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    changes = projection.fold_stream(source, ["seq"])
    state = {}

    def keep(df, _):
        for r in df.collect():
            state[r.record_id] = r

    changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    batch = {r.record_id: r for r in projection.fold_ordered(spark.createDataFrame(rows, schema), ["seq"]).collect()}
    assert {k: tuple(v) for k, v in state.items()} == {k: tuple(v) for k, v in batch.items()}


def test_inbox_takes_each_event_once_across_restarts(spark, tmp_path):
    schema = "event_id string, seq long, delivered_at timestamp, hops int"
    moment = datetime.datetime(2024, 1, 1)
    handled = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = inbox.receive(stream, f"{tmp_path}/inbox", f"{tmp_path}/cp", "sub", lambda df, n: handled.extend(r.event_id for r in df.select("event_id").collect()))
        query.awaitTermination()

    for part, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(i, k, moment, 0) for k, i in enumerate(ids)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    run()
    spark.createDataFrame([("c", 9, moment, 0), ("d", 10, moment, 11), ("e", 11, moment, 10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p2")
    run()
    assert sorted(handled) == ["a", "b", "c", "e"]


def test_numbering_in_ranges_is_gap_free(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    got = {r.k: r.seq for r in folds.numbered_in_ranges(df, ["k"], 10, 13).collect()}
    assert got == {k: k + 11 for k in range(1000)}


def test_idempotent_windows(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("p", "k", t + datetime.timedelta(hours=h), f) for h, f in ((0, "x"), (1, "x"), (2, "y"), (23, "x"), (24, "y"), (25, "x"), (49, "z"))]
    df = spark.createDataFrame(rows, "principal string, key string, at timestamp_ntz, fingerprint string")
    got = [r.outcome for r in folds.idempotent(df, ["at"]).orderBy("at").collect()]
    assert got == ["runs", "replays", "conflicts", "replays", "runs", "conflicts", "runs"]


def test_quarantine_and_dead_letters(spark):
    now = datetime.datetime(2024, 1, 1, 1)
    rows = [("p", 3, now, ["a", "b"]), ("p", 1, now, ["c"]), ("p", 1, now - datetime.timedelta(seconds=31), None)]
    df = spark.createDataFrame(rows, "projection string, attempts int, first_failed_at timestamp, subjects array<string>")
    assert sorted((r.subject for r in inbox.quarantined(df, F.lit(now)).collect()), key=str) == [None, "a", "b"] or sorted(str(r.subject) for r in inbox.quarantined(df, F.lit(now)).collect()) == ["None", "a", "b"]
    failures = spark.createDataFrame([("s", "e", 3, now, "x"), ("s", "e", 3, now + datetime.timedelta(1), "y"), ("s", "f", 2, now, "z")], "subscription string, event_id string, attempts int, failed_at timestamp, error string")
    assert [(r.event_id, r.error) for r in inbox.dead_letters(failures).collect()] == [("e", "y")]


# --- archive ----------------------------------------------------------------------------------------------------


def test_archive_files_round_trip_and_digest(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    c = archive.ArchiveClass("orders", "o_orderkey", ("o_orderpriority",), "o_orderdate", "o_orderstatus = 'F'", 365)
    found = archive.candidates(orders, spark.createDataFrame([], "root_id long"), c, F.lit("2001-08-31").cast("timestamp_ntz"))
    units, members = archive.units_of(found, c)
    assert units.agg(F.sum("members")).first()[0] == found.count() == members.count()
    rows = orders.join(members.withColumnRenamed("root_id", "o_orderkey"), "o_orderkey").select("unit", "o_orderkey", "o_orderpriority", "o_orderdate")
    kinds = {"o_orderkey": "bigint", "o_orderpriority": "text", "o_orderdate": "timestamp"}
    sums, digests = archive.digests({"orders": (rows, kinds, ["o_orderkey"])}, c)
    path = files.write_table(rows, str(tmp_path), 1, "orders")
    declared = StructType([f for f in rows.schema.fields if f.name != "unit"])
    again = files.read_table(spark, path, declared)
    assert sorted(map(tuple, archive.digests({"orders": (again, kinds, ["o_orderkey"])}, c)[1].collect())) == sorted(map(tuple, digests.collect()))
    one_unit = units.first().unit
    assert files.read_table(spark, path, declared, [one_unit]).select("unit").distinct().collect()[0].unit == one_unit
    assert files.manifest(sums, 1).count() == units.count()
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_table(rows, str(tmp_path), 1, "orders")
    with pytest.raises(SchemaMismatch):
        assert_schema(again.drop("unit"), StructType([StructField("x", LongType())]))


def test_history_is_the_same_at_every_stage(spark, small):
    """Before sealing, after copying, after publishing and after release, a subject reads the same rows."""
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    c = archive.ArchiveClass("orders", "o_orderkey", ("o_orderpriority",), "o_orderdate", "o_orderstatus = 'F'", 365)
    resource = policy.Resource({"p": policy.Dimension("o_orderpriority")}, {"o_orderkey": policy.ORDINARY, "o_orderdate": policy.ORDINARY})
    plan = policy.compile_plan(resource, [policy.Segment("view", {"p": policy.Atom("in", values=("1-URGENT", "5-LOW"))}, ("o_orderkey", "o_orderdate"), "2000-01-01T00:00:00+00:00")], "view", "x", datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))
    found = archive.candidates(orders, spark.createDataFrame([], "root_id long"), c, F.lit("2001-08-31").cast("timestamp_ntz"))
    units, members = archive.units_of(found, c)
    copied = orders.join(members.withColumnRenamed("root_id", "o_orderkey"), "o_orderkey")
    answers = []
    for route, version, state, online, cold in (
        ("online", 0, "sealed", orders, copied.limit(0)), ("online", 0, "sealed", orders, copied), ("object", 3, "published", orders, copied), ("object", 3, "released", None, copied),
    ):
        told = units.withColumn("route", F.lit(route)).withColumn("route_version", F.lit(version)).withColumn("state", F.lit(state))
        online = archive.released(orders, "o_orderkey", members, told) if online is None else online
        answers.append(sorted(map(tuple, archive.history(online, cold, c, members, told, 5, resource, plan).collect()), key=str))
    assert answers[0] and all(a == answers[0] for a in answers)
    assert archive.barrier(copied.limit(3), "o_orderkey", members).count() == 3


def test_large_groupings_become_several_units(spark, monkeypatch):
    monkeypatch.setattr(archive, "MOST_MEMBERS", 50)
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("2020-01-05").cast("timestamp_ntz").alias("at"), F.lit("2020-01").alias("period"))
    c = archive.ArchiveClass("x", "k", ("g",), "at", "true", 1)
    units, members = archive.units_of(rows, c)
    assert members.count() == 400 and units.agg(F.max("members")).first()[0] <= 80
    blocked = spark.createDataFrame([(3, "pending")], "root_id long, reason string")
    assert archive.units_of(rows, c, blocked)[1].count() == 0


def test_claims_and_exports(spark, tmp_path):
    events = spark.createDataFrame([("a", bytearray(b"x" * 100)), ("b", bytearray(b"y"))], "event_id string, payload binary")
    held = files.claim_checked(events, "s3://store", 10)
    store = spark.createDataFrame([("s3://store/a", bytearray(b"x" * 100))], "uri string, content binary")
    back = {r.event_id: (bytes(r.payload), r.claim_ok) for r in files.resolved(held, store).collect()}
    assert back == {"a": (b"x" * 100, True), "b": (b"y", None)}
    broken = spark.createDataFrame([("s3://store/a", bytearray(b"z" * 100))], "uri string, content binary")
    assert {r.event_id: r.claim_ok for r in files.resolved(held, broken).collect()}["a"] is False
    rows = spark.createDataFrame([(1, None), (2, "x")], StructType([StructField("z", LongType()), StructField("a", StringType())]))
    assert files.write_export(rows, f"{tmp_path}/out") == 2
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"a":"x","z":2}', '{"a":null,"z":1}']


def test_orders_of_child_tables():
    children = [relations.Child("marks", "lines", "line", "id"), relations.Child("lines", "docs", "doc", "id")]
    assert [c.name for c in relations.by_depth("docs", children)] == ["lines", "marks"]
    with pytest.raises(ValueError):
        relations.by_depth("docs", [relations.Child("x", "nowhere", "a", "b")])


def test_warm_rows_are_replaced_by_unit_version_and_table(spark, tmp_path):
    schema = "unit string, version int, table string, pk string, row string"
    files.write_warm(spark.createDataFrame([("u", 1, "t", "a", "1"), ("v", 1, "t", "a", "1"), ("u", 1, "s", "a", "1")], schema), f"{tmp_path}/warm")
    files.write_warm(spark.createDataFrame([("u", 1, "t", "b", "2")], schema), f"{tmp_path}/warm")
    got = sorted((r.unit, r.table, r.pk) for r in spark.read.parquet(f"{tmp_path}/warm").collect())
    assert got == [("u", "s", "a"), ("u", "t", "b"), ("v", "t", "a")]


def test_operations_log_and_generations(spark, tmp_path):
    lines = [{"id": "1", "kind": "backup", "received": "2024-01-01T00:00:00Z", "body": "{}", "valid": True}, {"id": "2", "kind": "backup", "valid": False}, {"id": "3", "kind": "trust", "valid": True}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    assert [r.id for r in files.operations(spark, f"{tmp_path}/log", "backup").collect()] == ["1"]
    some = spark.createDataFrame([(3,), (7,)], "generation int")
    assert files.next_generation(some, some.where("generation < 5")).first().generation == 8
    assert files.next_generation(some.limit(0), some.limit(0)).first().generation == 1


def test_streaming_numbers_go_on_and_restart_with_an_epoch(spark, tmp_path):
    from recordloom.streaming import outbox

    schema = "partition int, epoch string, ord long"
    batches = [[(0, "1.0", 1), (0, "1.0", 2), (1, "1.0", 3)], [(0, "1.0", 5), (0, "2.0", 6), (1, "1.0", 4)], [(0, "2.0", 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = outbox.numbered_stream(stream, f"{schema}, seq long")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.partition, r.ord, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 5, 3), (0, 6, 1), (0, 9, 2), (1, 3, 1), (1, 4, 2)]


def test_snapshot_pages_and_pending_partitions(spark):
    from recordloom.streaming import outbox

    records = spark.createDataFrame([(f"r{i:03d}", i) for i in range(25)], "record_id string, version long")
    seen, after = [], None
    while True:
        rows = [r.record_id for r in outbox.snapshot_page(records, after, 10).collect()]
        seen += rows[:10]
        if len(rows) <= 10:
            break
        after = rows[9]
    assert seen == [f"r{i:03d}" for i in range(25)]
    box = spark.createDataFrame([("s", 0, 1, None), ("s", 1, None, None), ("s", 2, 1, datetime.datetime(2024, 1, 1))], "stream string, partition int, seq long, published_at timestamp")
    assert sorted(r.partition for r in outbox.unpublished(box).collect()) == [0, 1]


def test_purge_of_work_items_waits_for_the_time_table(spark):
    from recordloom.operators import commands

    now = datetime.datetime(2024, 2, 1)
    old = now - datetime.timedelta(days=10)
    rows = [("a", "j", "succeeded", old, None), ("b", "j", "succeeded", old, now), ("c", "j", "succeeded", old, old), ("d", "j", "dead", old, None), ("e", "j", "dead", old - datetime.timedelta(days=25), None), ("f", "j", "running", old, None)]
    items_ = spark.createDataFrame(rows, "id string, job string, state string, finished_at timestamp, slot_at timestamp")
    marks = spark.createDataFrame([("j", old)], "job string, watermark_at timestamp")
    assert sorted(r.id for r in commands.purgeable(items_, marks, F.lit(now)).collect()) == ["a", "c", "e"]


def test_repeats_within_a_delay_are_dropped(spark, tmp_path):
    schema = "event_id string, delivered_at timestamp"
    t = datetime.datetime(2024, 1, 1)
    for k, rows in enumerate(([("a", t), ("b", t), ("a", t)], [("a", t + datetime.timedelta(minutes=1)), ("c", t)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = inbox.once_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "10 minutes")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_command_logs_fold_to_their_state(spark):
    from recordloom.operators import commands

    logs = {
        "done": [("claim", None, 1), ("before_send", None, 2), ("send_result", "accepted", 3), ("query_found", "succeeded", 4), ("query_found", "failed", 5)],
        "retried": [("claim", None, 1), ("send_result", "not_reached", 2), ("claim", None, 3), ("send_result", "maybe_reached", 4), ("query_not_found", None, 100)],
        "late": [("claim", None, 1), ("send_result", "maybe_reached", 2), ("query_not_found", None, 20_000)],
        "unknown": [("claim", None, 1), ("lease_lost", None, 2), ("query_unavailable", None, 50_000), ("query_unavailable", None, 90_000)],
        "expired": [("claim", None, 1), ("send_result", "maybe_reached", 2), ("query_unavailable", None, 999_999)],
        "untouched": [("query_found", "succeeded", 1)],
    }
    rows = [(name, e, r, at, 10_000.0, True, True, 0.0, 500_000.0 if name == "expired" else None) for name, log in logs.items() for e, r, at in log]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "command string, event string, result string, at long, dedupe_s double, last_use boolean, query boolean, processing_s double, abandon double")
    got = {r.command: (r.state, r.steps) for r in commands.command_states(df, ["at"]).collect()}
    assert got == {"done": ("succeeded", 5), "retried": ("sending", 5), "late": ("manual", 3), "unknown": ("manual", 4), "expired": ("failed", 3), "untouched": ("prepared", 1)}


def test_reservation_logs_fold_like_the_table(spark):
    from recordloom.operators import commands

    logs = {"a": ["hold-enough", "confirm", "consume-within", "consume-exact", "cancel"], "b": ["hold-short", "confirm"], "c": ["cancel", "hold-other"], "d": ["query"], "e": ["hold-enough", "expire"]}
    rows = [(b, c, k, b == "e") for b, log in logs.items() for k, c in enumerate(log)]
    got = {r.branch: (r.state, r.changes) for r in commands.reservation_states(spark.createDataFrame(rows, "branch string, command string, seq int, past boolean"), ["seq"]).collect()}
    assert got == {"a": ("consumed", 4), "b": ("rejected", 1), "c": ("cancelled", 1), "d": ("absent", 0), "e": ("expired", 2)}


def test_approval_instances(spark):
    from recordloom.operators import commands

    logs = {"a": [(1, "approve"), (2, "approve")], "r": [(1, "approve"), (2, "reject"), (2, "approve")], "w": [(2, "approve"), (1, "approve")], "n": [(2, "reject")]}
    rows = [(i, k, step, choice, 2, "returned") for i, log in logs.items() for k, (step, choice) in enumerate(log)]
    got = {r.instance: (r.state, r.step) for r in commands.instance_states(spark.createDataFrame(rows, "instance string, seq int, step int, choice string, steps int, on_reject string"), ["seq"]).collect()}
    assert got == {"a": ("approved", 2), "r": ("returned", 2), "w": ("running", 2), "n": ("running", 1)}


def test_candidates_of_repeated_and_missing_names(spark):
    from recordloom.operators import commands

    rnd = random.Random(7)
    pick = lambda prefix, n: rnd.choice([None, *(f"{prefix}{i}" for i in range(n))])
    for _ in range(3):
        tasks = [(rnd.choice([None, *range(12)]), pick("e", 2), rnd.choice([None, 0, 1]), pick("a", 7)) for _ in range(30)]
        holders = [(pick("e", 2), rnd.choice([None, 0, 1]), pick("a", 6)) for _ in range(30)]
        persons = [(pick("a", 5), pick("p", 2)) for _ in range(7)]
        of = lambda account: {person or a for a, person in persons if a == account and a} or {account}  # noqa: E731, B023
        want = {
            (task, a) for task, e, p, initiator in tasks for e2, p2, a in holders
            if None not in (e, p) and (e, p) == (e2, p2) and any(x and y and x != y for x in of(a) for y in of(initiator))
        }
        got = commands.candidates_of(
            spark.createDataFrame(tasks, "task int, entity string, position int, initiator string"), spark.createDataFrame(holders, "entity string, position int, account string"), spark.createDataFrame(persons, "account string, person string"),
        ).collect()
        assert len(got) == len(want) and {(r.task, r.account) for r in got} == want


def joined_rows(plan):
    """Rows that the joins of a plan that has run made."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(map(joined_rows, below)) + (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0)


def test_tasks_meet_each_account_of_a_position_once(spark):
    from recordloom.operators import commands

    tasks = spark.range(200).selectExpr("id AS task", "0 AS position", "'me' AS initiator")
    holders = spark.range(6000).selectExpr("0 AS position", "concat('a', id % 3) AS account")
    found = commands.candidates_of(tasks, holders, spark.createDataFrame([("a0", "p"), ("me", "p")], "account string, person string"))
    assert sorted({(r.task, r.account) for r in found.collect()}) == [(t, a) for t in range(200) for a in ("a1", "a2")]
    assert joined_rows(found._jdf.queryExecution().executedPlan()) < 20_000  # 200 tasks of 6 000 holders: 1 200 000


def test_alignment_rules(spark):
    """One log per rule: what a source's state becomes, and the action."""
    confirmed = (("foreign", 5), ("operator_confirms", 5))
    cases = [
        ([("adopt_epoch", 2)], ("aligning", "refetch")),
        ([("adopt_epoch", 2), ("alignment_done", 2)], ("aligned", "watermark_from_echoes")),
        ([("alignment_done", 2)], ("aligned", "alert")),
        ([("rollback", 3)], ("stalled", "refetch")),
        ([("rollback", 3), ("first_contact", 9)], ("stalled", "keep_refetching")),
        ([("rollback", 3), ("adopt_epoch", 3)], ("stalled", "keep_refetching")),
        ([("rollback", 3), ("adopt_epoch", 4)], ("aligning", "refetch")),
        ([("rollback", 3), ("adopt_epoch", 4), ("alignment_done", 3)], ("stalled", "alert")),
        ([("rollback", 3), ("adopt_epoch", 4), ("alignment_done", 4)], ("aligned", "watermark_from_echoes")),
        ([("foreign", 5)], ("blocked", "alert_and_hold")),
        ([("foreign", 5), ("foreign", 5)], ("blocked", "alert")),
        ([("foreign", 5), ("primary_response", 5)], ("blocked", "hold")),
        ([*confirmed], ("blocked", "record_confirmation")),
        ([*confirmed, ("primary_response", 5, False)], ("blocked", "alert")),
        ([*confirmed, ("primary_response", 5, False), ("primary_response", 5)], ("blocked", "hold")),
        ([*confirmed, ("primary_response", 5)], ("aligning", "row_check_then_refetch")),
        ([*confirmed, ("primary_response", 5, True, "failed")], ("stalled", "refetch")),
        ([("rollback", 3), *confirmed, ("primary_response", 3)], ("stalled", "refetch")),
        ([("rollback", 3), *confirmed, ("primary_response", 4)], ("aligning", "row_check_then_refetch")),
        ([("foreign", 5), ("environment_copy", 5)], ("aligning", "clear_and_refetch")),
    ]
    rows = [(c, n, kind, gen, rest[0] if rest else True, rest[1] if len(rest) > 1 else "passed") for c, (log, _) in enumerate(cases) for n, (kind, gen, *rest) in enumerate(log)]
    log = spark.createDataFrame(rows, "source int, n int, kind string, gen long, matches boolean, row_check string")
    got = {r.source: (r.state, r.action) for r in decisions.alignment_states(log, ["n"], "aligned").collect()}
    assert [got[c] for c in range(len(cases))] == [want for _, want in cases]


def test_canonical_values_have_an_inverse_and_refusals(spark):
    cases = [("bigint", "12"), ("bigint", "012"), ("smallint", "70000"), ("numeric", "1.50"), ("numeric", "9" * 38), ("numeric", "-0"), ("date", "2024-02-30"), ("date", "2024-02-29"),
             ("uuid", "123e4567-e89b-12d3-a456-426614174000"), ("uuid", "x"), ("binary", "YWJj"), ("binary", "YWJ"), ("timestamp", "2024-01-01T00:00:00.000000Z"), ("timestamp", "2024-01-01"), ("text", "x")]
    wanted = ["12", None, None, "1.5", "9" * 38, None, None, "2024-02-29", "123e4567-e89b-12d3-a456-426614174000", None, "abc", None, "2024-01-01 00:00:00", None, "x"]
    got = []
    for kind, text in cases:
        value = canonical.from_canonical(F.col("t"), kind)
        got.append(spark.createDataFrame([(text,)], "t string").select(value.cast("string").alias("v")).first().v)
    assert got == wanted


def test_canonical_booleans_and_lists_stay_json(spark):
    df = spark.createDataFrame([(True, ["e\u0301", "x"]), (None, None)], "b boolean, t array<string>")
    body = canonical.canonical_object({"b": canonical.canonical(F.col("b"), "boolean"), "t": canonical.canonical(F.col("t"), "text[]")})
    assert [r.x for r in df.select(body.alias("x")).collect()] == ['{"b":true,"t":["\u00e9","x"]}', "{}"]


def test_negative_weights_are_refused(spark):
    df = spark.createDataFrame([(1, 10, 3), (1, 10, -1), (2, 10, 1), (2, 10, 2)], "g int, total long, w int")
    got = sorted(((r.g, r.w, r.part) for r in decimals.allocate(df, ["g"], "total", "w", ["w"]).collect()), key=str)
    assert got == [(1, -1, None), (1, 3, None), (2, 1, 3), (2, 2, 7)]


def test_numbers_do_not_depend_on_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 3).cast("int").alias("p"), F.when(F.col("id") % 5 > 0, F.col("id") * 7 % 499).alias("o"), "id")
    counters = spark.createDataFrame([(0, 1000), (1, 5)], "p int, last_seq long")
    plain = sorted((r.id, r.seq) for r in folds.numbered(rows, ["p"], ["o", "id"], counters).collect())
    for ranges in (1, 7, 40):
        assert sorted((r.id, r.seq) for r in folds.numbered(rows, ["p"], ["o", "id"], counters, ranges).collect()) == plain


def test_pages_are_ranges_of_numbers(spark):
    from recordloom.streaming import outbox

    rows = spark.createDataFrame([(p, s) for p, low, high in ((0, 5, 20), (1, 1, 3), (2, 1, 2)) for s in range(low, high + 1)], "partition int, seq long")
    asked = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 0)], "partition int, after long")
    got = sorted((r.partition, r.seq, r.reset) for r in outbox.read_after(rows, asked, 3).collect())
    assert got == [(0, 5, True), (0, 6, True), (0, 7, True), (1, 2, False), (1, 3, False)]
    echoes = spark.createDataFrame([(0, 6), (1, 3), (2, 2)], "partition int, echo long")
    pulled = sorted((r.partition, r.seq, r["last"]) for r in projection.pull_page(rows, asked, echoes, 3).collect())
    assert pulled == [(0, 5, False), (0, 6, True), (1, 2, False), (1, 3, True)]


def test_fresh_marks_need_every_partition(spark):
    t = datetime.datetime(2024, 1, 10)
    marks = spark.createDataFrame([("a", t), ("b", t - datetime.timedelta(days=3))], "p string, mark timestamp")
    assert {r.days: r.fresh for r in folds.fresh_within(marks, "mark", [0, 3]).collect()} == {0: False, 3: True}
    assert [r.fresh for r in folds.fresh_within(marks.unionByName(spark.createDataFrame([("c", None)], "p string, mark timestamp")), "mark", [99]).collect()] == [False]
    assert [r.fresh for r in folds.fresh_within(marks.limit(0), "mark", [1]).collect()] == [False]
