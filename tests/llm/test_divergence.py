import re
from collections import Counter

import duckdb
import pytest

from recordloom.llm import divergence
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k):
    held, seen = {}, {}
    for _, text, lang, source, *_ in docs:
        words = Counter(TERM.findall((text or "").translate(LOWER)))
        held.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(words.keys())
    out = []
    for lang, sources in held.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]

        def likely(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = likely(sum(sources.values(), Counter()))
        p = {s: likely(c) for s, c in sources.items()}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if sources[s][t] > 0 and p[s][t] > whole[t]]
            for part, rows in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:k])):
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 200])
def test_against_brute_force(spark, small, monkeypatch, k):
    monkeypatch.setattr(divergence, "CHUNK", 9000)
    monkeypatch.setattr(divergence, "LIST_BLOCK", 3)
    monkeypatch.setattr(divergence, "PAIRS", 50)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    docs = plain_documents(small) + odd_rows() + [(7000 + i, f"Common words, the {i % 3} same", "en", "hot", 20) for i in range(80)]
    docs += [(8000, "alone in its language", "xx", "one", 0), (8001, None, "yy", "a", 0), (8002, "", "yy", "b", 0)]
    df = with_clashes(spark.createDataFrame(docs, SCHEMA)).repartition(4)
    assert found(divergence.audit(df, k=k)) == brute(docs, k)


def test_odd_rows_against_sql(spark):
    docs = odd_rows() * 3 + plain_documents("/root/testdata/sf0.001")[:80]
    df = spark.createDataFrame(docs, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert found(divergence.audit(df)) == sorted(con.execute(divergence.ORACLE_SQL).fetchall()) == brute(docs, 200)


def test_tables_too_large_to_travel_are_joined(spark, small, monkeypatch):
    monkeypatch.setattr(divergence, "NEAR", 2)
    docs = plain_documents(small)[:100]
    assert found(divergence.audit(spark.createDataFrame(docs, SCHEMA), k=5)) == brute(docs, 5)


def test_only_buckets_that_may_hold_a_top_term_are_evaluated(spark, monkeypatch):
    evaluated = []
    written = divergence.written
    monkeypatch.setattr(divergence, "written", lambda df: evaluated.append(df.columns) or written(df))
    texts = [("a", "rare " * 50)] * 3 + [("b", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)))] * 3
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, (s, t) in enumerate(texts)], SCHEMA)
    rows = divergence.occurrences(lists := divergence.postings(df), divergence.group_sizes(df, lists))
    before = len(evaluated)
    assert divergence.top_terms(rows, 1).count() == 2
    assert len(evaluated) - before == 3  # buckets, the first choice and its evaluation: no second round


def test_wide_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 3 * 10**13, 10**15 + 7, 10**6
    row = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + kept)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
