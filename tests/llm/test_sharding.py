import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.llm import sharding
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 24, 25, 1000])
def test_permutation_and_its_inverse(spark, n):
    order = sharding.Permutation(n, 3)
    rows = spark.range(n).select("id", order.place(F.col("id")).alias("place")).withColumn("back", order.number(F.col("place"))).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_large_numbers_and_walks_have_an_inverse(spark):
    for n in (1 << 61, (1 << 55) + 12345, 10**12 + 39):
        order = sharding.Permutation(n)
        rows = spark.range(50).select((F.lit(n - 1) - F.col("id") * 7).alias("x"))
        told = rows.select("x", order.place(F.col("x")).alias("p")).withColumn("back", order.number(F.col("p"))).collect()
        assert all(0 <= r.p < n and r.back == r.x for r in told) and len({r.p for r in told}) == 50
    wasteful = sharding.Permutation(10)  # 4 x 3 places: some numbers walk
    assert wasteful.beyond == 2


def told(rows):
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows), key=str)


def check(found, rows):
    assert len(found) == len(rows)
    counts = {}
    for r in found:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in counts.values())
    sizes = [len(counts.get(s, [])) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    wanted = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=str) == wanted


def test_rows_order_and_partitions_play_no_part(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = plain_documents(small)[:150] + odd_rows() + [(77, "the same", "en", "hot", 8)] * 200
    df = spark.createDataFrame(rows, SCHEMA)
    one = sharding.shards_of(df.repartition(5)).collect()
    check(one, rows)
    other = sharding.shards_of(with_clashes(df.orderBy(F.desc("n_chars"))).repartition(2)).collect()
    assert told(one) == told(other)


def test_row_numbers_are_ranks_of_digests(spark):
    rows = [(i % 5, f"text {i % 9}", None, None, 0) for i in range(60)]
    found = sharding.sharded(sharding.document_digests(spark.createDataFrame(rows, SCHEMA)), 7).collect()
    digests = sorted(hashlib.md5(f"{i}+{t}".encode()).hexdigest() for i, t, *_ in rows)
    assert [r.digest for r in sorted(found, key=lambda r: r.row_number)] == digests


def test_shard_and_slot_of_a_row_number_and_back(spark):
    rows = [(i, f"text {i}", None, None, 0) for i in range(100)]
    found = sharding.sharded(sharding.document_digests(spark.createDataFrame(rows, SCHEMA)), 7)
    alone = sharding.whereabouts(spark.range(100).withColumnRenamed("id", "row_number"), 100, 7)
    assert {(r.row_number, r.shard, r.slot) for r in found.collect()} == {(r.row_number, r.shard, r.slot) for r in alone.collect()}
    back = sharding.row_numbers(alone.select("shard", "slot", F.col("row_number").alias("was")), 100, 7).collect()
    assert all(r.row_number == r.was for r in back)


def test_seed_and_shards_change_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"t{i}", None, None, 0) for i in range(64)], SCHEMA)
    places = [tuple(r.place for r in sharding.sharded(sharding.document_digests(df), 4, seed).orderBy("row_number").collect()) for seed in (1, 2)]
    assert places[0] != places[1]


def test_written_shards_hold_whole_rows(spark, tmp_path, small):
    rows = plain_documents(small)[:60] + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    sharding.write_shards(df, str(tmp_path / "shards"), 5, rows_per_file=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc_id", "text", "lang", "source", "n_chars").collect())) == sorted(map(str, df.collect()))
    wanted = sharding.shards_of(df, 5).select("doc_id", "shard", "slot").collect()
    assert sorted(map(str, back.select("doc_id", "shard", "slot").collect())) == sorted(map(str, wanted))


def test_odd_rows_against_sql(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert told(sharding.shards_of(df).collect()) == sorted(con.execute(sharding.oracle_sql()).fetchall(), key=str)


def test_empty_table_and_no_python(spark, small):
    assert sharding.shards_of(spark.createDataFrame([], SCHEMA)).collect() == []
    df = sharding.shards_of(spark.read.parquet(f"{small}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
