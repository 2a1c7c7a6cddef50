import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from recordloom.llm import treaps
from recordloom.llm.common import BATCH_BYTES, small_batches
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t, *_ in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    holding = {}
    for _, t in held:
        for x in set(t):
            holding[x] = holding.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, t in held:
            m = 10 + (90 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in query & set(t))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 10])
def test_against_brute_force_in_many_chunks(spark, small, monkeypatch, k):
    monkeypatch.setattr(treaps, "CHUNK", 6000)
    monkeypatch.setattr(treaps, "BLOCK_TERMS", 60)
    monkeypatch.setattr(treaps, "WALKED", 40)
    monkeypatch.setattr(treaps, "FAN_IN", 2)
    docs = plain_documents(small)[:120] + odd_rows()
    docs += [(5000 + i, "the same words again and again", "en", "hot", 30) for i in range(60)]
    items = [(i, d[1][:200]) for i, d in enumerate(docs[:6])] + [(6, "the same words"), (6, "twice the same row"), (7, None), (8, " \n"), (9, "zzzz-unseen"), (None, "eine lange zeile WORD")]
    items.append((10, " ".join(d[1][:100] for d in docs[:20])))
    df = with_clashes(spark.createDataFrame(docs, SCHEMA)).repartition(5)
    some = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS rank").repartition(3)
    assert found(treaps.search(df, some, k)) == brute(docs, items, k)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "alpha beta", None, None, 0) for i in (9, 3, -4, 12, 7)] + [(20, "gamma", None, None, 0)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    rows = treaps.search(df, spark.createDataFrame([(1, "beta")], "item_id long, text string"), 3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [-4, 3, 7]


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 40, 5)
        starts = np.append(0, np.cumsum(sizes))
        keys = rng.integers(0, 6, starts[-1])
        roots, left, right = treaps.linked(starts, keys)
        none = len(keys)
        for root, first, last in zip(roots, starts[:-1], starts[1:], strict=True):
            stack, order, node = [], [], root
            while stack or node != none:
                while node != none:
                    assert all(child == none or keys[child] <= keys[node] for child in (left[node], right[node]))
                    stack.append(node)
                    node = left[node]
                node = stack.pop()
                order.append(node)
                node = right[node]
            assert order == list(range(first, last))


def test_most_intervals_are_left(monkeypatch):
    rng = np.random.default_rng(5)
    docs, impacts, starts = [], [], [0]
    for _ in range(4):
        own = np.sort(rng.choice(20_000, 8000, replace=False))
        docs.append(own)
        impacts.append((rng.pareto(1.5, len(own)) * 1000).astype(np.int64) + 1)
        starts.append(starts[-1] + len(own))
    docs, impacts = np.concatenate(docs), np.concatenate(impacts)
    roots, left, right = treaps.linked(np.array(starts), impacts << 32)
    chunk = treaps.Chunk(np.arange(20_000), np.arange(4, dtype=np.uint64), np.array(starts), roots, np.append(docs, 2**31 - 1).astype(np.int32), np.append(impacts, 0).astype(np.int32), left, right)
    scored = []
    split = treaps._split
    monkeypatch.setattr(treaps, "_split", lambda c, node, s, b, e: scored.append(len(np.unique(s))) or split(c, node, s, b, e))
    _, score, doc = treaps.walk(chunk, np.zeros(4, np.int64), roots, np.ones(4, np.int64), np.ones(1, np.int64), 10)
    whole = np.bincount(docs, weights=impacts, minlength=20_000).astype(np.int64)
    order = np.lexsort((np.arange(20_000), -whole))[:10]
    assert doc.tolist() == order.tolist() and score.tolist() == whole[order].tolist()
    assert sum(scored) < 4000


def test_wide_lengths_stay_exact():
    times, lengths = np.array([1, 5]), np.array([10**9, 7])
    got = treaps.impacts(times, lengths, 10**10, 10**13)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * n * 10**10 // 10**13)) for t, n in zip(times.tolist(), lengths.tolist(), strict=True)]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert treaps.search(none, items).collect() == []
    assert treaps.search(spark.createDataFrame(odd_rows(), SCHEMA), items.limit(0)).collect() == []


BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_task_holds_little_of_what_it_reads(spark, monkeypatch):
    session, before, seen = spark, spark.conf.get(BATCHES), []
    keep = treaps.written
    monkeypatch.setattr(treaps, "written", lambda *a, **b: seen.append(session.conf.get(BATCHES)) or keep(*a, **b))
    docs = spark.range(0, 12, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 120000), x -> hex(x * 12 + id)), ' ') AS text")
    index = treaps.index(docs)
    groups = [m.row_group(i) for f in index.inputFiles() if (m := pq.ParquetFile(f.removeprefix("file://")).metadata).num_rows for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 2 and sum(g.total_byte_size for g in groups) > 40 << 20
    assert max(g.total_byte_size for g in groups) < 32 << 20
    items = spark.createDataFrame([(1, f"{12 * 70_000 + 7:x}"), (2, f"{12 * 119_999 + 11:x}")], "item_id long, text string")
    assert [r[:3] for r in found(treaps.ranked(index, items, 12))] == [(1, 1, 7), (2, 1, 11)]
    assert len(seen) == 3 and set(seen) == {f"{BATCH_BYTES}b"} and spark.conf.get(BATCHES) == before


def test_small_batches_end_with_their_block(spark):
    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"bytes": [b.nbytes]})

    before, rows = spark.conf.get(BATCHES), spark.range(0, 60, 1, 1).selectExpr("repeat('x', 100000) AS t").mapInArrow(sizes, "bytes long")
    with pytest.raises(ZeroDivisionError), small_batches(spark, 1 << 20):
        told = [r.bytes for r in rows.collect()]
        raise ZeroDivisionError
    assert max(told) < 1200000 and sum(told) > 6000000 and spark.conf.get(BATCHES) == before
