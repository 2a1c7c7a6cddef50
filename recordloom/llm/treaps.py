"""Ranked lexical search in inverted treaps.

Documents are indexed where they are read, in chunks of bounded text. In a chunk each term has a treap of its postings:
a binary tree in search order of document ids and in heap order of impacts (what a posting adds to a score before the
term's weight), equal impacts in an order of hashes, so that trees stay shallow. All treaps of a chunk are flat arrays.

A search walks the treaps of an item's terms at once, over intervals of ids. The nodes that head an interval bound what
its documents can score: the sum of their weighted impacts. An interval whose bound is below the k-th best score known
to the task is left; else the document of the largest addend is scored, found or missed on one path of each treap, and
splits the interval in two. Intervals of many items and of one depth are walked together as arrays.

Scale. Two scans of the texts (lengths of the collection, then the index), and one scan of the index for each block of
items, whose terms travel to the tasks (BLOCK_TERMS at most). Texts and postings are never shuffled: what leaves a task
is a document frequency for each term of the block and k rows for each item, which meet in a tree of merges. A task holds
some megabytes of texts and a chunk of the index at a time, however much it reads: chunks are written in small row groups
and, as the texts, handed to Python in small batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import LARGE_ROWS, received, sent_to_tasks, small_batches, written

CHUNK = 2 << 20  # bytes of text indexed together, one document at least
BLOCK_TERMS = 1 << 18  # terms of the items that are searched together
WALKED = 1 << 18  # postings below the treaps that are walked together, one item at least
FAN_IN = 32
# The weights of the ranking.
LENGTH_SHARE, LENGTH_SCALE, TERM_SCALE, IMPACT_SCALE, WEIGHT_SCALE = 90, 100, 1000, 1_000_000_000, 1000

INDEX_SCHEMA = "ids binary, n_ids int, terms binary, starts binary, roots binary, docs binary, impacts binary, left binary, right binary"


def _terms_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of a batch, in order."""
    data, at = tb.utf8(batch.column("text"))
    folded, starts, ends, doc = tb.word_spans(data, at, tb.plain_words())
    return tb.word_hashes(folded, starts, ends), doc


def collection_lengths(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, total = 0, 0
        for whole in batches:
            for batch, _ in tb.slices(whole):
                data, at = tb.utf8(batch.column("text"))
                _, starts, _, doc = tb.word_spans(data, at, tb.plain_words())
                some, total = some + len(np.unique(doc)), total + len(starts)
        yield pa.RecordBatch.from_pydict({"some": pa.array([some], pa.int64()), "total": pa.array([total], pa.int64())})

    counted = docs.select("text").where("text IS NOT NULL").mapInArrow(count, "some long, total long").agg(F.sum("some").alias("some"), F.sum("total").alias("total"))
    with small_batches(docs.sparkSession):
        row = counted.first()
    return row.some or 0, row.total or 0


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that a document of a length holds so many times adds to the score, for a weight of 1."""
    wide = LENGTH_SHARE * int(lengths.max(initial=0)) * documents >= 1 << 63
    lengths = lengths.astype(object) if wide else lengths.astype(np.int64)
    shaped = (LENGTH_SCALE - LENGTH_SHARE + LENGTH_SHARE * lengths * documents // max(1, terms)).astype(np.int64)
    return IMPACT_SCALE * times // (TERM_SCALE * times + 8 * shaped)


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents, and of those that hold it."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def linked(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots, left, right) of the treap of every run of ``keys`` between ``starts``; len(keys) stands for no node.

    A node's parent is the smaller of the nearest greater keys on either side. Those are found for all nodes at once:
    what is not greater is passed by way of its own nearest one.
    """
    n = len(keys)
    wall = np.append(keys, np.iinfo(np.int64).max)
    nearest = []
    for ends, step, passed in ((starts[:-1], -1, np.less), (starts[1:] - 1, 1, np.less_equal)):
        to = np.append(np.arange(n) + step, n)
        to[ends] = n
        active = np.flatnonzero(passed(wall[to[:n]], keys))
        while len(active):
            to[active] = to[to[active]]
            active = active[passed(wall[to[active]], keys[active])]
        nearest.append(to[:n])
    low, high = nearest
    left, right = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
    after = (low < n) & ((high == n) | (wall[low] < wall[high]))
    before = (high < n) & ~after
    right[low[after]] = np.flatnonzero(after)
    left[high[before]] = np.flatnonzero(before)
    return np.flatnonzero(~after & ~before).astype(np.int32), left, right


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows in the order of their ids, nulls last, in tables of about ``size`` bytes of text."""
    held: list[pa.RecordBatch] = []
    amount = 0

    def whole() -> pa.Table:
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        return rows.take(order).combine_chunks()

    for batch in batches:
        for piece, own in tb.slices(batch, size=max(1, size // 4)):
            held.append(piece)
            amount += own
            if amount >= size:
                yield whole()
                held, amount = [], 0
    if held:
        yield whole()


def index(docs: DataFrame, lengths: tuple[int, int] | None = None) -> DataFrame:
    """Treaps of all terms of all ``docs`` (columns ``doc_id, text``), one row for each chunk, written to the shared folder.

    A null text has no term; a document without a term is in no treap. Terms are told apart by hashes of 64 bits.
    """
    documents, total = lengths or collection_lengths(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, CHUNK):
            hashes, owners, done = [], [], 0
            for batch in rows.to_batches():
                for piece, _ in tb.slices(batch):
                    found, doc = _terms_of(piece)
                    hashes.append(found)
                    owners.append((doc + done).astype(np.int32))
                    done += len(piece)
            term, owner = np.concatenate(hashes), np.concatenate(owners)
            n_terms = np.bincount(owner, minlength=done)
            order = np.argsort(term, kind="stable")
            term, owner = term[order], owner[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))[: len(term)])
            times = np.diff(np.append(first, len(term)))
            term, owner = term[first], owner[first]
            runs = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            starts = np.append(runs, len(term)).astype(np.int64)
            gain = impacts(times, n_terms[owner], documents, total)
            keys = (gain << 32) | (tb.mix(owner.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            roots, left, right = linked(starts, keys)
            ids = rows.column("doc_id").combine_chunks()
            known = len(ids) - ids.null_count
            columns = {
                "ids": np.asarray(ids.slice(0, known)).astype(np.int64), "terms": term[runs], "starts": starts, "roots": roots,
                "docs": np.append(owner, np.iinfo(np.int32).max).astype(np.int32), "impacts": np.append(gain, 0).astype(np.int32), "left": left, "right": right,
            }
            out = {name: pa.array([values.tobytes()], pa.binary()) for name, values in columns.items()}
            out["n_ids"] = pa.array([len(ids)], pa.int32())
            del rows, hashes, owners, term, owner, order, keys, columns
            yield pa.RecordBatch.from_pydict({name: out[name] for name in (x.split()[0] for x in INDEX_SCHEMA.split(", "))})
            pa.default_memory_pool().release_unused()

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return written(texts.mapInArrow(build, INDEX_SCHEMA), **LARGE_ROWS)


@dataclass
class Chunk:
    """The treaps of a chunk; the last element of each array of nodes stands for no node."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    roots: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch) -> Iterator[Chunk]:
        kinds = {"ids": np.int64, "terms": np.uint64, "starts": np.int64, "roots": np.int32, "docs": np.int32, "impacts": np.int32, "left": np.int32, "right": np.int32}
        for i in range(len(batch)):
            yield Chunk(**{name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()})


@dataclass
class Block:
    """Items whose terms travel together: term ``terms[at[j]]`` for j from ``starts[i]`` to ``starts[i + 1]`` is item i's."""

    items: list
    starts: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def first_k(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int, missing: np.ndarray | None = None) -> np.ndarray:
    """Places of the k first of each item, by item, then descending score, then document, those of a missing id last."""
    order = np.lexsort((doc, *(() if missing is None else (missing,)), -score, item))
    item = item[order]
    head = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
    return order[np.arange(len(item)) - np.repeat(head, np.diff(np.append(head, len(item)))) < k]


def least_needed(item: np.ndarray, score: np.ndarray, k: int, n_items: int) -> np.ndarray:
    """For each item the score that a further document must reach: the k-th of a full list, else 1."""
    need = np.ones(n_items, np.int64)
    full = np.bincount(item, minlength=n_items) >= k
    last = np.cumsum(np.bincount(item, minlength=n_items)) - 1
    need[full] = score[last[full]]
    return need


def walk(chunk: Chunk, item: np.ndarray, node: np.ndarray, weights: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, score, document) of each item's k best of a chunk that reach ``need``.

    ``item`` (ascending), ``node`` and ``weights`` are the entries of the first intervals: one for each item and term, at
    the root of the term's treap. Only intervals whose bound is strictly below what is needed are left.
    """
    none, n_items = len(chunk.docs) - 1, len(need)
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    seen = need.copy()
    row, owner = item.astype(np.int64), item.astype(np.int64)
    begin, end = np.full(len(row), -1, np.int32), np.full(len(row), chunk.docs[none], np.int32)  # both lie outside their interval
    while len(row):
        added = weights * chunk.impacts[node]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        kept = np.repeat(np.add.reduceat(added, heads) >= seen[owner[heads]], np.diff(np.append(heads, len(row))))
        row, owner, node, weights, added, begin, end = (x[kept] for x in (row, owner, node, weights, added, begin, end))
        if not len(row):
            break
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        sizes = np.diff(np.append(heads, len(row)))
        top = (np.maximum.reduceat((added << 28) | chunk.docs[node], heads) & ((1 << 28) - 1)).astype(np.int32)
        split = np.repeat(top, sizes)
        found, low, high = _split(chunk, node, split, begin, end)
        score = np.add.reduceat(weights * found, heads)
        good = score >= seen[owner[heads]]
        best = tuple(np.concatenate(x) for x in zip(best, (owner[heads][good], score[good], top[good]), strict=True))
        order = first_k(*best, k)
        best = tuple(x[order] for x in best)
        seen = np.maximum(seen, least_needed(best[0], best[1], k, n_items))
        below, above = low != none, high != none
        row = np.concatenate([row[below] * 2, row[above] * 2 + 1])
        order = np.argsort(row, kind="stable")
        row = row[order]
        owner = np.concatenate([owner[below], owner[above]])[order]
        node = np.concatenate([low[below], high[above]])[order]
        weights = np.concatenate([weights[below], weights[above]])[order]
        begin = np.concatenate([begin[below], split[above]])[order]
        end = np.concatenate([split[below], end[above]])[order]
        row = np.cumsum(np.append(0, row[1:] != row[:-1]))[: len(row)]
    return best


def _split(chunk: Chunk, node: np.ndarray, split: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For treaps at ``node``: the impact of document ``split`` (0 if it isn't there), and the heads of what lies between
    ``begin`` and it, and between it and ``end``.

    One path: the first node on it between ``begin`` and the document (the document and ``end``) heads what lies there.
    Below the document itself, nodes out of the interval are passed."""
    none = len(chunk.docs) - 1
    found = np.zeros(len(node), np.int64)
    low, high = np.full(len(node), none, np.int32), np.full(len(node), none, np.int32)
    at, now = np.arange(len(node)), node
    met = []
    while len(at):
        doc, wanted = chunk.docs[now], split[at]
        before, after = doc < wanted, doc > wanted
        new = before & (low[at] == none) & (doc > begin[at])
        low[at[new]] = now[new]
        new = after & (high[at] == none) & (doc < end[at])
        high[at[new]] = now[new]
        hit = ~(before | after)
        own, top = at[hit], now[hit]
        found[own] = chunk.impacts[top]
        met.append((own, top))
        now = np.where(before, chunk.right[now], chunk.left[now])
        on = ~hit & (now != none)
        at, now = at[on], now[on]
    own, top = (np.concatenate(x) for x in zip(*met, strict=True))
    for heads, below, beyond, out in ((low, chunk.left, chunk.right, lambda doc, i: doc <= begin[i]), (high, chunk.right, chunk.left, lambda doc, i: doc >= end[i])):
        at = own[heads[own] == none]
        now = below[top[heads[own] == none]]
        while len(at):
            passed = (now != none) & out(chunk.docs[now], at)
            heads[at[~passed]] = now[~passed]
            at, now = at[passed], beyond[now[passed]]
    return found, low, high


def _lists(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k best for each item of a block."""
    block: Block = received(shared)
    item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
    missing = np.zeros(0, bool)
    part = TaskContext.get().partitionId()
    for batch in batches:
        for chunk in Chunk.read(batch):
            if not len(chunk.terms):
                continue
            place = np.minimum(np.searchsorted(chunk.terms, block.terms), len(chunk.terms) - 1)
            held = chunk.terms[place] == block.terms
            owners = np.repeat(np.arange(len(block.items)), np.diff(block.starts))
            here = held[block.at]
            owners, terms = owners[here], block.at[here]
            sizes = (chunk.starts[place + 1] - chunk.starts[place])[terms]
            below = np.add.reduceat(sizes, heads) if len(heads := np.flatnonzero(np.append(True, owners[1:] != owners[:-1])[: len(owners)])) else heads
            group = np.repeat((np.cumsum(below) - below) // WALKED, np.diff(np.append(heads, len(owners))))
            for g in np.unique(group).tolist():
                own = group == g
                need = least_needed(item, score, k, len(block.items))
                new = walk(chunk, owners[own], chunk.roots[place[terms[own]]], block.weights[terms[own]], need, k)
                lost = new[2] >= len(chunk.ids)
                ids = np.where(lost, 0, chunk.ids[np.minimum(new[2], len(chunk.ids) - 1)] if len(chunk.ids) else 0)
                item, score, doc, missing = (np.concatenate(x) for x in ((item, new[0]), (score, new[1]), (doc, ids), (missing, lost)))
                order = first_k(item, score, doc, k, missing)
                item, score, doc, missing = item[order], score[order], doc[order], missing[order]
    names = pa.array([block.items[i] for i in item.tolist()], pa.int64())
    columns = {"item_id": names, "doc_id": pa.array(doc, pa.int64(), mask=missing), "score": pa.array(score, pa.int64()), "part": pa.array(np.full(len(item), part, np.int64))}
    yield pa.RecordBatch.from_pydict(columns)


def _holding(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term of a block."""
    wanted = received(shared)
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for i in range(len(batch)):
            terms, starts = (np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in (("terms", np.uint64), ("starts", np.int64)))
            if len(terms):
                place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[place] == wanted, starts[place + 1] - starts[place], 0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "holding": pa.array(total[some], pa.int64())})


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the distinct hashed terms of every item that has one; rows of one id are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole):
                term, row = _terms_of(batch)
                yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id").take(pa.array(row)), "term": pa.array(term.view(np.int64))})

    texts = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return texts.mapInArrow(cut, "item_id long, term long").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def ranked(treaps: DataFrame, items: DataFrame, documents: int, k: int = 10) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: ``item_id, rank, doc_id, score``; ties to the smaller doc_id.

    ``treaps`` is the result of ``index``, ``documents`` the first of ``collection_lengths``. Terms are runs of letters and
    digits (every byte of a non-ASCII character counts as a letter), A-Z as a-z. Every row of the indexed table is a
    document of its own, so repeated rows take a rank each; null ids come last among equal scores. Rows of one item_id,
    null too, are one item; null, empty and termless items give no rows, nor do empty tables. Other columns play no part.
    """
    session = treaps.sparkSession
    found: list[DataFrame] = []
    held: list[tuple[int | None, np.ndarray]] = []

    def search_held() -> None:
        terms, at = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
        wanted = sent_to_tasks(session, terms)
        counted = treaps.select("terms", "starts").mapInArrow(lambda b: _holding(b, wanted), "term long, holding long").groupBy("term").agg(F.sum("holding").alias("holding"))
        weights = np.zeros(len(terms), np.int64)
        for row in counted.collect():  # BLOCK_TERMS and an item's terms at most
            weights[row.term] = weight(documents, row.holding)
        starts = np.append(0, np.cumsum([len(x) for _, x in held]))
        shared = sent_to_tasks(session, Block([i for i, _ in held], starts, at, terms, weights))
        held.clear()
        found.append(written(treaps.mapInArrow(lambda b: _lists(b, shared, k), "item_id long, doc_id long, score long, part long")))
        wanted.destroy()
        shared.destroy()

    with small_batches(session):
        for row in written(item_terms(items)).orderBy("item_id").toLocalIterator():  # a block is held at a time
            held.append((row.item_id, np.sort(np.array(row.terms, np.int64).view(np.uint64))))
            if sum(len(x) for _, x in held) >= BLOCK_TERMS:
                search_held()
        if held:
            search_held()
    lists = reduce(DataFrame.unionByName, found, session.createDataFrame([], "item_id long, doc_id long, score long, part long"))
    levels = math.ceil(math.log(max(2, lists.select("part").distinct().count()), FAN_IN))
    for level in range(levels - 1, 0, -1):
        lists = _best(lists.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(FAN_IN**level))), ["item_id", "part"], k).drop("rank")
    return _best(lists, ["item_id"], k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _best(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``ranked`` over a new index of all ``docs``."""
    lengths = collection_lengths(docs)
    return ranked(index(docs, lengths), items, lengths[0], k)


#: DuckDB SQL for ``search`` with k = 10.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+') AS t
  FROM documents WHERE text IS NOT NULL),
indexed AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM indexed),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10ffff}]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
words AS (SELECT r, doc_id, n, unnest(t) AS term FROM indexed),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term, nd),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term), total GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
