"""Helpers shared by the corpus operators: table access, lineage cuts and connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sent_to_tasks(spark: SparkSession, value: Any) -> Broadcast:
    """A value of bounded size for all tasks; the classes of this package travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> Any:
    """In a task: what ``sent_to_tasks`` sent."""
    return pickle.loads(shared.value)


BROADCAST_IDS = 1_000_000  # ids up to which they travel to the tasks (8 MB)


def of_ids(rows: DataFrame, ids: DataFrame, how: str, name: str = "doc_id") -> DataFrame:
    """Semi or anti join by an id: few ids travel to the tasks that read the rows, many are joined. In a semi join a
    null id is an id like others; in an anti join it matches none."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    told = ids.select(F.col(name).alias("_id"))
    same = F.col(name).eqNullSafe(F.col("_id")) if how == "left_semi" else F.col(name) == F.col("_id")
    return rows.join(F.broadcast(told) if few else told, same, how)


HOT = 256  # rows of a key that stay together; those of a hotter key are dealt to chunks
HOT_KEYS = 500_000  # hottest keys that are dealt (8 MB travel to the tasks); all others have fewer rows than these


def hot_keys(sizes: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``_key, _chunks`` of the keys with more than ``most`` (HOT) rows, the HOT_KEYS hottest at most; ``sizes`` has columns
    key, size. The result is written once, for any number of joins."""
    most = most or HOT
    hot = sizes.where(F.col("size") > most).select(F.col(key).alias("_key"), "size").orderBy(F.col("size").desc(), "_key").limit(HOT_KEYS)
    return F.broadcast(written(hot.select("_key", F.ceil(F.col("size") / most).alias("_chunks"))))


def dealt(rows: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` with ``_chunk``: rows of a hot key are dealt by a hash of ``by``."""
    told = rows.join(hot, F.col(key) == F.col("_key"), "left")
    return told.withColumn("_chunk", F.pmod(F.xxhash64(by), F.coalesce("_chunks", F.lit(1)))).drop("_key", "_chunks")


def join_dealt(many: DataFrame, few: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``many`` joined with ``few``, which has a row for each ``key``; a hot key of ``many`` is no single task, since its row
    of ``few`` is copied for every chunk."""
    copies = few.join(hot, F.col(key) == F.col("_key"), "left")
    copies = copies.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_chunks"), F.lit(1).cast("long")) - 1))).drop("_key", "_chunks")
    return dealt(many, key, by, hot).join(copies, [key, "_chunk"]).drop("_chunk")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where Spark runs on one machine and
    names none, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or tempfile.mkdtemp(prefix="recordloom-")).rstrip("/")


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later readers take the columns they need. ``options`` are
    the writer's."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Writer's options for rows of some megabytes. Parquet counts on small rows: it looks at the size of a row group after 100 of
#: them at the earliest, and a reader holds a whole row group at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}

BATCH_BYTES = 4 << 20  # one row at least


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs within hands rows to Python in batches of about ``size`` bytes and no longer of 64 MB, which every task holds
    outside of the JVM's heap (twice while they grow) and again in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component: columns ``node, component``.

    ``edges`` has two long columns ``a, b``; loops and repeated rows are allowed. Alternating star
    contraction (large-star, then small-star) needs a logarithmic number of rounds, keeps the number of
    edges from growing and moves only pairs of ids. Nodes with no edge other than a loop are left out. The pairs of a node
    with very many neighbours stream past its minimum in a sort-merge join, which adaptive execution splits where they
    exceed its skew threshold.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialize(
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v").distinct()
    )
    seen = state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now_state = state(now)
        if now_state == seen:
            break
        seen = now_state
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
