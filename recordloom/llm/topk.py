"""Exact top-k inner products by tiled matrix products.

Query vectors are packed in blocks and all vectors in shards. A task multiplies its shards with every block of a
round, selects the k best of each query and tile, and keeps one list for each query; the lists of all tasks are merged
in a tree, so no task ever holds more than a round of queries, one shard and FAN_IN lists.

Scale. Candidates are read where they lie and never shuffled: a round of queries (ROUND_BYTES at most) is sent to
the tasks, its lists are written to the shared folder, and the next round follows. A round costs one scan of the
candidates' two columns; what leaves a task is k rows for each query of the round. Components move as the smallest
integers that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import materialize, written

QUERY_BLOCK = 1024
SHARD = 4096
ROUND_BYTES = 32 << 20  # of query vectors sent to the tasks at once, beside one block more
FAN_IN = 32
SCALE = 256.0
LARGEST = 1.7e308


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, v``: floor(256 x) of every component of the vectors that take part.

    Null vectors, empty vectors and vectors with a null or non-finite component take no part, nor do rows of
    a null id.
    """
    good = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    )

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(x.cast("double") * F.lit(SCALE), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    v = F.transform("embedding", whole)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v"))


def smallest(data: np.ndarray) -> np.ndarray:
    """Whole numbers as the smallest signed integers that hold them; beyond 64 bits they stay doubles."""
    most = float(np.abs(data).max(initial=0))
    for kind in (np.int8, np.int16, np.int32, np.int64):
        if most < np.iinfo(kind).max:
            return data.astype(kind)
    return data


def blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors): rows of one dimension in blocks of up to ``size``."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def full(dim: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, data = (np.concatenate(x) for x in zip(*held[dim], strict=True))
        while len(ids) >= least:
            yield dim, ids[:size], data[:size]
            ids, data = ids[size:], data[size:]
        held[dim] = [(ids, data)]

    for batch in batches:
        dims, ids = np.asarray(batch.column("dim")), np.asarray(batch.column("vec_id"))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            data = np.asarray(batch.column("v").take(pa.array(at)).flatten()).reshape(len(at), dim)
            held.setdefault(dim, []).append((ids[at], data))
            if sum(len(x) for x, _ in held[dim]) >= size:
                yield from full(dim, size)
    for dim in held:
        yield from full(dim, 1)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``dim, kind, ids, data``: query vectors in blocks, as bytes of int64 and of the type ``kind``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, data in blocks_of(batches, size):
            data = smallest(data)
            columns = {"dim": pa.array([dim], pa.int32()), "kind": pa.array([data.dtype.name]), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(pack, "dim int, kind string, ids binary, data binary")


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, candidate's id, score) of each query's k best of a shard, in order of rows, then scores, ties to
    the smaller id; candidates of the query's own id are left out.

    Products are exact: in single precision while every sum stays below 2^24, in doubles below 2^53, else in Python's
    integers, whose scores beyond the range of long count as its ends.
    """
    wide = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if wide < 2.0**53:
        kind = np.float32 if wide < 2.0**24 else np.float64
        scores = q.astype(kind) @ c.astype(kind).T
        own = np.nonzero(np.isin(q_ids, c_ids))[0]
        if len(own):
            scores[own] = np.where(q_ids[own, None] == c_ids[None, :], -np.inf, scores[own])
        if scores.shape[1] > k:
            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            row, at = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        else:
            row, at = np.nonzero(scores > -np.inf)
        found = scores[row, at]
        return _first_k(row, c_ids[at], found.astype(np.int64), found, k)
    exact = np.vectorize(int, otypes=[object])
    scores = exact(q) @ exact(c).T
    rows, ids, values = [], [], []
    for i, query in enumerate(q_ids.tolist()):
        order = sorted((j for j in range(len(c_ids)) if c_ids[j] != query), key=lambda j: (-scores[i, j], c_ids[j]))[:k]
        rows += [i] * len(order)
        ids += [c_ids[j] for j in order]
        values += [max(-(1 << 63), min((1 << 63) - 1, int(scores[i, j]))) for j in order]
    return np.array(rows, np.int64), np.array(ids, np.int64), np.array(values, np.int64)


def _first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by descending ``key``, then id."""
    order = np.lexsort((ids, -key, row))
    row, ids, scores = row[order], ids[order], scores[order]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    kept = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row)))) < k
    return row[kept], ids[kept], scores[kept]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's ``k`` highest inner products: ``query_id, rank, vec_id, score``; fewer if there are fewer vectors.

    Both sides have columns ``vec_id, embedding``; others play no part. Vectors of another dimension than the query's are
    no candidates, nor are rows of the query's own id; ties go to the smaller id. Repeated rows of one id are a
    candidate each. Rows of one id among the queries give one list, of the k best of all their products. A score
    beyond the range of long counts as the end of that range. Empty tables give no rows.
    """
    blocks = materialize(_packed(quantized(queries).repartition(F.ceil(F.col("vec_id") / (QUERY_BLOCK * 50)).alias("part")), QUERY_BLOCK))
    candidates = quantized(vectors)
    schema = "query_id long, vec_id long, score long, part long"
    found = None
    held: list[tuple] = []

    def search_held() -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(list(held))
        held.clear()
        lists = written(candidates.mapInArrow(lambda batches: _lists(batches, shared.value, k), schema))
        shared.destroy()
        return lists

    for block in blocks.toLocalIterator():  # one round at a time is held
        held.append((block.dim, block.kind, bytes(block.ids), bytes(block.data)))
        if sum(len(x[3]) for x in held) >= ROUND_BYTES:
            lists = search_held()
            found = lists if found is None else found.unionByName(lists)
    if held:
        lists = search_held()
        found = lists if found is None else found.unionByName(lists)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    levels = math.ceil(math.log(max(2, found.select("part").distinct().count()), FAN_IN))
    for level in range(levels - 1, 0, -1):
        found = found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(FAN_IN**level)))
        found = _best(found, ["query_id", "part"], k).drop("rank")
    return _best(found, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lists(batches: Iterator[pa.RecordBatch], blocks: list[tuple], k: int) -> Iterator[pa.RecordBatch]:
    """A task's k best for each query of a round."""
    part = TaskContext.get().partitionId()
    tiles = [(dim, np.frombuffer(ids, np.int64), np.frombuffer(data, np.dtype(kind)).reshape(-1, dim)) for dim, kind, ids, data in blocks]
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(tiles)
    for dim, c_ids, c in blocks_of(batches, SHARD):
        for b, (q_dim, q_ids, q) in enumerate(tiles):
            if q_dim == dim:
                new = tile_best(q_ids, q, c_ids, c, k)
                both = new if best[b] is None else tuple(np.concatenate(x) for x in zip(best[b], new, strict=True))
                best[b] = _first_k(*both, both[2].astype(object) if both[2].min(initial=0) < -(1 << 62) else both[2], k)
    for (_, q_ids, _), lists in zip(tiles, best, strict=True):
        if lists is not None:
            row, ids, scores = lists
            names = {"query_id": q_ids[row], "vec_id": ids, "score": scores, "part": np.full(len(row), part, np.int64)}
            yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in names.items()})


def _best(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
