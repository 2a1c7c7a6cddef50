import duckdb
import numpy as np
import pytest

from recordloom.llm import topk
from recordloom.llm.queries import op9_top_k


def brute(rows, queries, k):
    good = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in [g for g in good if g[0] in queries]:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_small_table_against_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    expected = sorted(duckdb.sql(topk.ORACLE_SQL).fetchall())
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op9_top_k(spark, small).collect())
    assert found == expected and len(found) > 0


@pytest.mark.parametrize("k", [1, 5, 50])
def test_ties_nulls_dimensions_and_many_tiles(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    monkeypatch.setattr(topk, "ROUND_BYTES", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    rows += [(300, None), (301, []), (302, [1.0, None, 2.0, 0.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (310, [1.0, 2.0]), (320, [0.5, -0.1]), (350, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS block", "'y' AS score", "1 AS rank").repartition(5)
    found = topk.top_k(df, df.where("vec_id % 10 = 0"), k)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, k)


def test_large_products_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e4, 0.00390625]), (2, [2e4, 0.0078125])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 2).collect())
    assert got == brute(rows, {0}, 2)


def test_scores_beyond_long_are_its_ends(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e307]), (3, [1e308])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (3, (1 << 63) - 1), (2, -(1 << 63))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df, 5).collect() == []


def test_repeated_query_rows_make_one_list(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [0.0, 4.0]), (2, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 4).orderBy("rank").collect()]
    assert got == [(1, 2, 8 << 16), (2, 2, 8 << 16), (3, 1, 3 << 16), (4, 1, 3 << 16)]


def test_ties_of_negative_extremes(spark):
    rows = [(0, [1e300]), (5, [-1e308]), (4, [-1e308]), (3, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(3, -(1 << 63)), (4, -(1 << 63))]
