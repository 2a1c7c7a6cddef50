import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa

from recordloom.llm import common
from recordloom.llm import neardup as nd
from recordloom.llm import textbatch as tb
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes



def shingles_of(text):
    for gap in "\t\n\x0b\x0c\r\0":
        text = text.replace(gap, " ")
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in text.split(" ") if w]
    if not words:
        return Counter()
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)])


def brute(rows, spark):
    """Classes by comparing all pairs that share a shingle."""
    docs = [(i, shingles_of(t)) for i, t in rows if t is not None]
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "doc_id long, text string")
    idf = nd.weights_of(*nd.document_frequencies(df))
    hashed = {}
    for _, bag in docs:
        for s in bag:
            if s not in hashed:
                data, at = tb.utf8(pa.array([" ".join(s)]))
                folded, a, b, doc = tb.word_spans(data, at, tb.spaced_words())
                hashed[s] = int(tb.shingles(tb.word_hashes(folded, a, b), doc, 1, 5)[0][0])
    weights = [{s: n * idf[hashed[s] & (nd.BUCKETS - 1)] for s, n in bag.items()} for _, bag in docs]
    holders = defaultdict(list)
    for k, w in enumerate(weights):
        for s in w:
            holders[s].append(k)
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    margin = 1.0
    for k, w in enumerate(weights):
        for j in {j for s in w for j in holders[s] if j < k}:
            low = sum(min(v, weights[j].get(s, 0)) for s, v in w.items())
            s = low / (sum(w.values()) + sum(weights[j].values()) - low)
            margin = min(margin, abs(s - nd.SIMILARITY))
            if s >= nd.SIMILARITY:
                parent[root(k)] = root(j)
    empty = [k for k, w in enumerate(weights) if not w]
    for k in empty:
        parent[root(k)] = root(empty[0])
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = i if r not in least else min(least[r], i, key=lambda x: (x is None, x))
    out = [(docs[k][0], least[root(k)]) for k in range(len(docs))] + [(i, i) for i, t in rows if t is None]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()), key=str)


def planted():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    rows, i = [], 0
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.randint(40, 200))]
        for _ in range(rnd.randint(1, 40) if base else 120):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 80))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(1000 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(60)]
    rows += [(2000, "one two"), (2001, "One  TWO"), (2002, ""), (2003, None), (2004, " \n"), (2005, None)]
    return rows


def test_planted_copies_match_brute_force(spark):
    rows = planted()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows, spark)


def test_blocks_and_joins(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "HUB_CHUNK", 3)
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "HOT", 4)
    rows = planted()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, spark)


def test_small_table_with_odd_rows(spark, small):
    rows = plain_documents(small) + odd_rows()
    found = got(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute([r[:2] for r in rows], spark)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    sampler = nd.Sampler(np.ones(nd.BUCKETS), samples=2000)
    keys = tb.mix(np.arange(1, 201, dtype=np.uint64))
    a, b = keys[:160], keys[40:]
    na, nb = rng.integers(1, 4, 160), rng.integers(1, 4, 160)
    order_a, order_b = np.argsort(a), np.argsort(b)
    true = nd.weighted_jaccard((a[order_a], na[order_a].astype(float)), (b[order_b], nb[order_b].astype(float)))
    assert abs((sampler(a, na) == sampler(b, nb)).mean() - true) < 0.05


def test_samples_hardly_ever_hide_a_pair_at_the_threshold():
    n = nd.BANDS * nd.ROWS
    assert sum(comb(n, x) * nd.SIMILARITY**x * (1 - nd.SIMILARITY) ** (n - x) for x in range(n + 1) if x / n < nd.SIMILARITY - nd.SLACK) < 1e-4


def template_texts(n=160):
    """Texts that share 60 % of their words in one block, with pairs of near copies among them."""
    rnd = random.Random(23)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(3000)]
    template, rows = [rnd.choice(words) for _ in range(60)], []
    for k in range(n):
        own = [rnd.choice(words) for _ in range(22)]
        rows.append((k, " ".join(template + own)))
        if k % 4 == 0:
            rows.append((1000 + k, " ".join(template + own[:-1] + ["zz"])))
    return rows


def test_a_bucket_of_templates_is_compared_in_blocks_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 9)
    monkeypatch.setattr(common, "HOT", 5)
    rows = template_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows, spark)


def test_dealt_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    many = spark.range(200).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 11 END AS k", "id AS v")
    few = spark.range(9).selectExpr("id AS k", "id * 10 AS w")
    sizes = many.groupBy("k").count().withColumnRenamed("count", "size")
    assert sorted(common.join_dealt(many, few, "k", "v", common.hot_keys(sizes, "k")).collect()) == sorted(many.join(few, "k").collect())


def test_components_of_a_large_star_and_a_chain(spark):
    edges = [(500, k) for k in range(100, 160)] + [(k, k + 1) for k in range(20)] + [(3, 3), (160, 100)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 100 for k in [*range(100, 161), 500]} | {k: 0 for k in range(21)}
