"""Streams of numbers, redeliveries and published rows against their batch twins."""

import datetime

import pytest
from pyspark.sql import functions as F

from recordloom.streaming import delivery


@pytest.fixture
def states(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, delivery.PROVIDER)
    yield
    spark.conf.set(key, before)


def streamed(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def run(df, tmp_path):
    df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out")


def test_numbers_and_forks_of_a_stream_are_those_of_its_batch(spark, tmp_path, states):
    schema = "partition int, epoch string, ord long"
    batches = [
        [(0, "1.0", 1), (0, "1.0", 2), (1, "1.0", 3)],
        [(0, "1.0", 5), (0, "2.0", 6), (0, "2.1", 7), (1, "1.0", 4)],  # two changes within a batch
        [(0, "3.0", 9), (1, "2.0", 8)],  # changes between batches
    ]
    out = run(delivery.numbered_stream(streamed(spark, tmp_path, batches, schema)), tmp_path)
    whole = delivery.numbered_batch(spark.createDataFrame([r for b in batches for r in b], schema))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    forks = sorted((r.partition, r.old_epoch, r.fork_seq, r.epoch) for r in out.where("kind = 'fork'").collect())
    assert forks == [(0, "1.0", 3, "2.0"), (0, "2.0", 1, "2.1"), (0, "2.1", 1, "3.0"), (1, "1.0", 2, "2.0")]


def test_redelivery_follows_a_controlled_clock(spark, tmp_path, states):
    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    schema = "event_id string, fails int, at timestamp"
    later = [t + datetime.timedelta(seconds=s) for s in (0.5, 2, 2.5, 4, 6, 8, 100)]
    batches = [[("good", 0, t), ("once", 1, t), ("twice", 2, t), ("never", 9, t)], *([(f"tick{k}", 0, at)] for k, at in enumerate(later)), [("once", 1, later[-1])]]
    stream = streamed(spark, tmp_path, batches, schema).withWatermark("at", "0 seconds")
    out = run(delivery.redelivered_stream(stream, lambda e, attempt: f"failure {attempt}" if attempt <= e["fails"] else None), tmp_path)
    events = spark.createDataFrame(batches[0], schema)
    whole = delivery.redelivered_batch(events, F.col("fails"))
    plain = lambda df: sorted((r.event_id, r.attempt, r.outcome, r.at) for r in df.collect())
    first = out.where(~F.col("event_id").startswith("tick") & (F.col("at") < later[-1]))
    assert plain(first) == plain(whole)
    assert [(r.event_id, r.cause) for r in delivery.dead_letters(out).collect()] == [("never", "failure 3")]
    assert [(r.attempt, r.outcome, r.cause) for r in out.where("event_id = 'never'").orderBy("attempt", F.col("cause") != delivery.NO_OUTCOME).collect()] == [
        (1, "nak", "failure 1"), (2, "nak", "failure 2"), (3, "dead", delivery.NO_OUTCOME), (3, "dead", "failure 3")]
    # until the last delivery has ended, its dead letter stands
    assert [r.cause for r in delivery.dead_letters(out.where("event_id = 'never' AND cause <> 'failure 3'")).collect()] == [delivery.NO_OUTCOME]


def test_waits_double_up_to_their_bound():
    assert [delivery.wait_seconds(n) for n in range(1, 8)] == [1, 2, 4, 8, 16, 30, 30]


def test_a_failing_row_stops_its_partition_only_and_is_sent_again(spark, tmp_path):
    schema = "partition int, seq long, payload string"
    sent, flag = tmp_path / "sent.log", tmp_path / "works"
    sent.touch()

    def send(row):
        if row.partition == 0 and row.seq == 2 and not flag.exists():
            raise ConnectionError("down")
        with sent.open("a") as f:
            f.write(f"{row.partition} {row.seq} {row.payload}\n")

    def prepare(df):
        return df.withColumn("payload", F.when(F.length("payload") > 5, F.concat(F.lit("claim:"), F.length("payload").cast("string"))).otherwise(F.col("payload")))

    def once(rows, k):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        delivery.forward(stream, f"{tmp_path}/box", f"{tmp_path}/cp", prepare, send).awaitTermination()

    def lines(partition):
        return [x for x in sent.read_text().splitlines() if x.startswith(f"{partition} ")]

    once([(0, 3, "c"), (0, 1, "a"), (0, 2, "b" * 9), (1, 2, "y"), (1, 1, "x")], 0)
    assert lines(0) == ["0 1 a"] and lines(1) == ["1 1 x", "1 2 y"]
    once([(0, 4, "d"), (1, 3, "z")], 1)  # the failing row still fails: nothing passes it
    assert lines(0) == ["0 1 a"] and lines(1)[-1] == "1 3 z"
    flag.touch()
    once([(0, 5, "e")], 2)
    assert lines(0) == ["0 1 a", "0 2 claim:9", "0 3 c", "0 4 d", "0 5 e"] and len(lines(1)) == 3
    assert spark.read.parquet(f"{tmp_path}/box/held/batch=2").count() == 0
