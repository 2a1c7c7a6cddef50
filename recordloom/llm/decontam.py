"""Benchmark passages inside documents by size-partitioned MinHash containment search.

Items (short) and documents (long) are sets of shingles of five words. Items are grouped by size, and for each
group documents are cut into overlapping segments, so that every passage of an item's length lies whole in one
of them; segments are partitioned by size, and each partition takes as many single-row bands as its largest
size needs for a containment of 0.8 (the tuning of LSH Ensemble: the containment threshold becomes a Jaccard
threshold that depends on the sizes). Items too short for the bands there are, are looked up by their shingles.
A candidate is verified by the exact share of the item's shingles that the whole document holds.

Scale. One pass over the documents and no shuffle of text. Items are taken in blocks of a fixed size and similar
sizes, so what travels through the driver to the tasks is bounded; a block's pairs are written to the shared folder before
the next one is fetched, and a longer list of items costs another pass for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import of_ids, written

WIDTH = 5
CONTAINMENT = 0.8
SEGMENT = 192  # shingles of a segment at most, beside its overlap
BLOCK_ITEMS = 4000  # items sent to the tasks at once
BLOCK_SHINGLES = 400_000  # and their shingles at most, but for a single longer item
MISS = 1e-3  # chance to overlook a pair just at the threshold
MAX_HASHES = 256
SEED = 7919


def least_shared(n: int, containment: float) -> int:
    """Shingles of an item of ``n`` that a document must hold to contain it."""
    return max(1, math.ceil(containment * n - 1e-9))


def bands_needed(size: int, sizes: list[int], containment: float) -> int:
    """Bands of one row, by which segments of ``size`` shingles find a contained item of any of the ``sizes``.

    A segment with m of an item's q shingles agrees with it in a band with m / (size + q) at least, so the bound
    on what is overlooked holds for shingles that are scattered over several segments, too.
    """
    worst = max((size + q) / least_shared(q, containment) for q in sizes)
    return max(4, math.ceil(-math.log(MISS) * worst))


def owners(rows: np.ndarray, owner: np.ndarray, values: np.ndarray) -> set[int]:
    """Owners of the sorted ``rows`` that are equal to one of the ``values``."""
    at = np.searchsorted(rows, values)
    hit = rows[np.minimum(at, len(rows) - 1)] == values
    out: set[int] = set()
    for value, first in zip(values[hit], at[hit], strict=True):
        out.update(owner[first : int(np.searchsorted(rows, value, "right"))].tolist())
    return out


class SizeGroup:
    """Items of similar sizes and their MinHash index; the segments are at least as long as the longest item."""

    def __init__(self, members: list[int], sets: list[np.ndarray], sizes: list[int], containment: float):
        self.longest = max(sizes)
        self.step = max(SEGMENT, self.longest)
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(1, 1 << 62, MAX_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands = {size: bands_needed(size, sizes, containment) for size in self.segment_sizes()}
        most = max(self.bands.values())
        low = np.stack([self.minima(sets[i], most) for i in members])
        self.salts = tb.mix(np.arange(1, most + 1, dtype=np.uint64))
        rows = (low ^ self.salts[None, :]).ravel()
        order = np.argsort(rows, kind="stable")
        self.rows, self.owner = rows[order], np.repeat(np.array(members), most)[order]

    @staticmethod
    def largest_segment(longest: int) -> int:
        return max(SEGMENT, longest) + longest

    def segment_sizes(self) -> list[int]:
        """Upper sizes of the partitions of segments: doubling up to a whole segment."""
        top, out, size = self.largest_segment(self.longest), [], 16
        while size < top:
            out.append(size)
            size *= 2
        return [*out, top]

    def minima(self, keys: np.ndarray, n: int) -> np.ndarray:
        return (keys[:, None] * self.factors[None, :n]).min(axis=0)

    def candidates(self, keys: np.ndarray) -> set[int]:
        """Items that share the minimum of a band with a segment of a document's shingles."""
        out: set[int] = set()
        for first in range(0, max(1, len(keys) - self.longest), self.step):
            segment = keys[first : first + self.step + self.longest]
            n = self.bands[next(s for s in self.bands if len(segment) <= s)]
            out |= owners(self.rows, self.owner, self.minima(segment, n) ^ self.salts[:n])
        return out


class ItemBlock:
    """Shingle sets of a block of items, split by size.

    A group takes as many sizes as MAX_HASHES bands suffice for. Items so short that these are too few even for
    their own size are looked up exactly: a document that contains an item of n shingles lacks less than
    n - least_shared(n) + 1 of them, so it holds one of any so many; the rarest ones of the block are taken.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], containment: float):
        self.ids, self.sets, self.containment = ids, sets, containment
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            by_size.setdefault(len(s), []).append(i)
        sizes, self.groups, exact = sorted(by_size), [], []
        while sizes:
            k = 0
            while k < len(sizes) and bands_needed(SizeGroup.largest_segment(sizes[k]), sizes[: k + 1], containment) <= MAX_HASHES:
                k += 1
            if k:
                self.groups.append(SizeGroup([i for n in sizes[:k] for i in by_size[n]], sets, sizes[:k], containment))
            else:
                exact += by_size[sizes[0]]
            sizes = sizes[max(1, k) :]
        self.rows, self.owner = self._rarest(exact)

    def _rarest(self, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not members:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, times = np.unique(np.concatenate([self.sets[i] for i in members]), return_counts=True)
        rows, owner = [], []
        for i in members:
            s = self.sets[i]
            taken = len(s) - least_shared(len(s), self.containment) + 1
            rows.append(s[np.argsort(times[np.searchsorted(keys, s)], kind="stable")[:taken]])
            owner += [i] * taken
        order = np.argsort(np.concatenate(rows), kind="stable")
        return np.concatenate(rows)[order], np.array(owner)[order]

    def search(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shared shingles, the item's shingles) for every item contained in a document's shingle run."""
        if not len(keys) or not self.sets:
            return []
        found = owners(self.rows, self.owner, np.unique(keys)) if len(self.rows) else set()
        for group in self.groups:
            found |= group.candidates(keys)
        if not found:
            return []
        own = np.unique(keys)
        out = []
        for i in sorted(found):
            s = self.sets[i]
            at = np.searchsorted(own, s)
            shared = int((own[np.minimum(at, len(own) - 1)] == s).sum())
            if shared >= self.containment * len(s) - 1e-9:
                out.append((i, shared, len(s)))
        return out


def _shingles_of(batch: pa.RecordBatch, table: np.ndarray, width: int):
    data, at = tb.utf8(batch.column("text"))
    folded, starts, ends, doc = tb.word_spans(data, at, table)
    found, whose = tb.shingles(tb.word_hashes(folded, starts, ends), doc, len(batch), width)
    words = np.bincount(doc, minlength=len(batch))
    return found, tb.by_text(whose, len(batch)), words


def item_sets(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, keys``: the distinct shingles of every item that has a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.plain_words()
        for whole in batches:
            for batch in tb.pieces(whole):
                found, runs, _ = _shingles_of(batch, table, width)
                keys = [np.unique(found[runs[d] : runs[d + 1]]).view(np.int64) for d in range(len(batch))]
                yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "keys": pa.array(keys, pa.list_(pa.int64()))})

    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(cut, "item_id long, keys array<long>").where(F.size("keys") > 0)


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and an item it contains: ``doc_id, item_id, shared, item_shingles, containment``.

    Words are runs of letters and digits (every byte of a non-ASCII character counts as a letter), A-Z as a-z,
    so punctuation and line breaks do not hide a passage. Null or wordless texts and items take no part. An item
    of fewer than ``width`` words is one shingle and is found only as a whole text of the same words. Repeated
    rows of either side give repeated pairs of documents and one pair for each item id; empty tables give no rows.
    """
    sets = item_sets(benchmark, width).groupBy("item_id", "keys").agg(F.size(F.first("keys")).alias("n"))
    schema = "doc_id long, item_id long, shared int, item_shingles int, containment double"
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found: list[DataFrame] = []
    ids: list[int] = []
    keys: list[np.ndarray] = []

    def search_held() -> None:
        shared = docs.sparkSession.sparkContext.broadcast((list(ids), list(keys)))
        ids.clear()
        keys.clear()
        found.append(written(_search_block(texts, shared, width, containment, schema)))
        shared.destroy()

    for row in sets.orderBy("n", "item_id").toLocalIterator():  # one block is held at a time, and leaves with its search
        ids.append(row.item_id)
        keys.append(np.array(row["keys"], np.int64).view(np.uint64))
        if len(ids) >= BLOCK_ITEMS or sum(map(len, keys)) >= BLOCK_SHINGLES:
            search_held()
    if ids:
        search_held()
    return reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], schema))


def _search_block(texts: DataFrame, shared: Broadcast, width: int, containment: float, schema: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = ItemBlock(*shared.value, containment), tb.plain_words()
        for whole in batches:
            for batch in tb.pieces(whole):
                found, runs, _ = _shingles_of(batch, table, width)
                doc_ids, out = batch.column("doc_id").to_pylist(), []
                for d in range(len(batch)):
                    for i, common, n in block.search(found[runs[d] : runs[d + 1]]):
                        out.append((doc_ids[d], block.ids[i], common, n, common / n))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                names = ("doc_id", "item_id", "shared", "item_shingles", "containment")
                yield pa.RecordBatch.from_pydict({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds, strict=True)})

    return texts.mapInArrow(search, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows without an id stay."""
    bad = written(contained_items(docs, benchmark).select("doc_id").distinct())
    return of_ids(docs, bad, "left_anti")


#: DuckDB SQL for the rows of ``contained_items`` with its production parameters.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+') AS w
  FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+')
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words WHERE len(w) > 0),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 1)
SELECT d.id AS doc_id, item_id, count(*)::INT AS shared, any_value(n)::INT AS item_shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM shingles d JOIN items i ON d.s = i.s WHERE side = 0 GROUP BY d.id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""
