"""The archive on files: jobs that end half-way, stale jobs, untouched files, destruction resumed."""

import pytest
from pyspark.sql import functions as F

from recordloom.sources.coldstore import ColdStore, CopyFailed, StaleClaim, Table, void_exports

TABLES = {"roots": Table({"id": "bigint", "name": "text", "secret": "text"}, ("id",), "id"), "parts": Table({"root": "bigint", "n": "int", "secret": "text"}, ("root", "n"), "root")}


@pytest.fixture
def online(spark):
    roots = spark.createDataFrame([(i, f"r{i}", f"s{i}") for i in range(12)], "id long, name string, secret string")
    parts = spark.createDataFrame([(i, k, f"p{i}") for i in range(12) for k in range(i % 3)], "root long, n int, secret string")
    return {"roots": roots, "parts": parts}


@pytest.fixture
def store(spark, tmp_path, online):
    made = ColdStore(spark, str(tmp_path / "archive"), "things", TABLES, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    made.seal(spark.createDataFrame([(f"u:{i % 3} x", i) for i in range(9)], "unit string, root_id long"), online)
    return made


def units(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "unit string")


def state(store, version=None):
    return {r.unit: (r.state, r.version) for r in store.units(version).collect()}


def seen(store, online, version=None):
    rows = store.warm("roots", online["roots"], version).unionByName(store.cold("roots", version).drop("unit"))
    return sorted(tuple(r) for r in rows.select("id", "name", "secret").collect())


def test_reads_are_the_same_at_every_stage(spark, store, online):
    every = sorted(tuple(r) for r in online["roots"].collect())
    assert seen(store, online) == every
    store.transfer(units(spark, "u:0 x", "u:1 x"), online)
    assert state(store) == {"u:0 x": ("published", 1), "u:1 x": ("published", 1), "u:2 x": ("sealed", 0)}
    assert seen(store, online) == every and seen(store, online, 1) == every
    store.release(units(spark, "u:0 x"))
    released = store.members().where("unit = 'u:0 x'").select(F.col("root_id").alias("id"))
    left = online | {"roots": online["roots"].join(released, "id", "left_anti")}
    assert seen(store, left) == every and store.cold("roots").count() == 6
    assert {r.ok for r in store.intact(store.units()).collect()} == {True}


def test_a_transfer_that_ends_half_way_shows_nothing_and_can_be_repeated(spark, store, online):
    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.transfer(units(spark, "u:0 x"), online, before_publish=killed)
    assert store.catalog_version() == 1 and state(store)["u:0 x"] == ("sealed", 0) and store.cold("roots").count() == 0
    left = store.orphans(F.lit("2024-01-01").cast("timestamp")).count()
    assert left == 1  # this unit's roots have no parts
    store.transfer(units(spark, "u:0 x"), online)
    assert state(store)["u:0 x"] == ("published", 1) and store.orphans(F.lit("2024-01-01").cast("timestamp")).count() == left
    assert store.cold("roots").count() == 3


def test_a_stale_transfer_publishes_nothing(spark, store, online):
    def other():
        store.transfer(units(spark, "u:1 x"), online)

    with pytest.raises(StaleClaim):
        store.transfer(units(spark, "u:0 x", "u:1 x"), online, before_publish=other)
    assert state(store) == {"u:0 x": ("sealed", 0), "u:1 x": ("published", 1), "u:2 x": ("sealed", 0)}
    rows = store.units()
    store.publish(rows, store.catalog_version())
    staged = store.publish
    with pytest.raises(StaleClaim):
        staged(rows, store.catalog_version() - 1)


def test_a_copy_of_other_rows_fails(spark, store, online):
    with pytest.raises(CopyFailed, match="u:0 x"):
        store.transfer(units(spark, "u:0 x"), online | {"roots": online["roots"].where("id <> 3")})
    assert state(store)["u:0 x"] == ("sealed", 0)


def test_erasing_reads_and_writes_only_the_units_of_the_erased(spark, store, online):
    store.transfer(units(spark, "u:0 x", "u:1 x"), online)
    before = {r.unit: r.digest for r in store.units().collect()}
    store._delete(store.objects().where("unit = 'u:1 x'"))  # if the erasure read them, it would fail
    ids = spark.createDataFrame([(0,), (2,), (11,)], "root_id long")
    told = {r.root_id: r for r in store.erase(ids, ("secret",), online).collect()}
    assert {k: r.outcome for k, r in told.items()} == {0: "erased", 2: "erased", 11: "online"}
    after = {r.unit: r.digest for r in store.units().collect()}
    assert after["u:1 x"] == before["u:1 x"] and after["u:0 x"] != before["u:0 x"] and after["u:2 x"] != before["u:2 x"]
    assert state(store) == {"u:0 x": ("published", 2), "u:1 x": ("published", 1), "u:2 x": ("sealed", 0)}
    rows = {r.id: r.secret for r in store.rows("roots", store.units().where("unit = 'u:0 x'")).collect()}
    assert rows == {0: None, 3: "s3", 6: "s6"}
    held = units(spark, "u:0 x")
    assert {r.outcome for r in store.erase(spark.createDataFrame([(3,)], "root_id long"), ("secret",), online, held).collect()} == {"deferred"}
    again = {r.root_id: r.new for r in store.erase(spark.createDataFrame([(0,)], "root_id long"), ("secret",), online, held, redo=True).collect()}
    assert again == {0: after["u:0 x"]}


def test_a_destruction_that_ends_between_its_phases_is_resumed(spark, store, online):
    store.transfer(units(spark, "u:0 x", "u:1 x", "u:2 x"), online)
    reasons = {"u:0 x": [], "u:1 x": ["held"], "u:2 x": []}

    def asked():
        return spark.createDataFrame(list(reasons.items()), "unit string, reasons array<string>")

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.destroy(asked, "retention", after_intent=killed)
    assert state(store)["u:0 x"] == ("published", 1) and sorted(r.unit for r in store.pending().collect()) == ["u:0 x", "u:2 x"]
    reasons["u:2 x"] = ["held"]  # a hold came meanwhile
    told = {r.unit: (list(r.reasons), r.state) for r in store.destroy(asked, "retention").collect()}
    assert told == {"u:0 x": ([], "destroyed"), "u:1 x": (["held"], "published"), "u:2 x": (["held"], "published")}
    assert sorted((r.unit, r.phase) for r in store.evidence().collect()) == [("u:0 x", "effective"), ("u:0 x", "intent"), ("u:2 x", "cancelled"), ("u:2 x", "intent")]
    assert {r.unit for r in store.objects().collect()} == {"u:1 x", "u:2 x"} and store.pending().count() == 0
    assert [r[0] for r in seen(store, online)] == [1, 2, 4, 5, 7, 8, 9, 10, 11]
    store.destroy(asked, "retention")
    assert state(store)["u:0 x"] == ("destroyed", 1)


def test_snapshots_before_during_and_after_a_reroute_agree(spark, store, online):
    first = store.transfer(units(spark, "u:0 x", "u:1 x", "u:2 x"), online)
    last = store.reroute(units(spark, "u:1 x"), "warm")
    assert {r.unit: r.route for r in store.units().collect()} == {"u:0 x": "object", "u:1 x": "warm", "u:2 x": "object"}
    assert seen(store, online, first) == seen(store, online, last)
    now = F.lit("2024-01-02").cast("timestamp")
    lease = spark.createDataFrame([(first,)], "catalog_version int").withColumn("expires_at", F.lit("2024-01-03").cast("timestamp"))
    kept = store.release_old(now, 60, lease, F.lit(None).cast("timestamp")).collect()
    assert [(r.unit, r.reasons) for r in kept] == [("u:1 x", ["lease", "no_backup"])] and seen(store, online, first) == seen(store, online, last)
    gone = store.release_old(now, 60, lease.limit(0), now).collect()
    assert [(r.unit, r.reasons) for r in gone] == [("u:1 x", [])]
    assert store.old_versions().count() == 0 and len(seen(store, online, last)) == 12


def test_voided_exports(spark):
    rows = spark.createDataFrame([(1, "things", "done", None), (2, "things", "pending", None), (3, "other", "done", None)], "export long, class string, state string, erased_at timestamp").withColumn("expires_at", F.lit(None).cast("timestamp"))
    told = {r.export: (r.expires_at is not None, r.erased_at is not None) for r in void_exports(rows, "things", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert told == {1: (True, False), 2: (False, True), 3: (False, False)}
