import random
import re

import pyarrow.parquet as pq

from recordloom.llm import decontam
from recordloom.llm.queries import op5_decontamination
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes


def words_of(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def shingles_of(text):
    words = words_of(text or "")
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(docs, items):
    sets = [(i, shingles_of(t)) for i, t in items if i is not None and t is not None]
    out = set()
    for d, t in docs:
        own = shingles_of(t)
        for i, s in sets:
            if s and len(own & s) >= 0.8 * len(s):
                out.add((d, i, len(own & s), len(s)))
    return sorted(out, key=str)


def got(df):
    return sorted({(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in df.collect()}, key=str)


def test_small_table_matches_brute_force(spark, small):
    items = [tuple(r.values()) for r in pq.read_table(f"{small}/benchmark.parquet").select(["item_id", "text"]).to_pylist()]
    found = got(op5_decontamination(spark, small))
    assert found == brute([r[:2] for r in plain_documents(small)], items) and found


def test_items_in_long_documents_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, prose(rnd.randint(5, 120))) for i in range(20)]
    docs = []
    for i, item in items:
        for place in (0, 180, 200, 1000):
            cut = list(item)
            for _ in range(rnd.choice([0, 0, 1, max(1, len(item) // 40)])):
                cut[rnd.randrange(len(cut))] = "zzz"
            docs.append((len(docs), " ".join(prose(place) + cut + prose(rnd.randint(0, 800))).replace(" ", rnd.choice([" ", ", ", "\n"]))))
    docs += [(1000 + k, " ".join(prose(300))) for k in range(20)]
    rows = [(d, t, "en", "web", len(t)) for d, t in docs] + odd_rows()
    texts = [(i, " ".join(w).upper() if i % 2 else " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, "a b c d e f"), (52, "word")]
    bench = spark.createDataFrame(texts, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS n")
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    expected = brute([r[:2] for r in rows], texts)
    assert got(decontam.contained_items(df, bench)) == expected and len(expected) > 60
    dirty = {e[0] for e in expected}
    clean = decontam.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in rows if r[0] is None or r[0] not in dirty), key=str)


def test_short_items_beside_long_ones(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, prose((5, 6, 9, 12, 15, 40)[i % 6])) for i in range(240)] + [(1000, prose(2004)), (1001, prose(504))]
    docs = []
    for i, item in items:
        half = len(item) // 2
        docs.append((len(docs), " ".join(prose(300) + item + prose(200))))
        if len(item) > 30:  # in two places: the four shingles across the cut are missing
            docs.append((len(docs), " ".join(prose(100) + item[:half] + prose(600) + item[half:] + prose(100))))
    texts = [(i, " ".join(w)) for i, w in items]
    rows = [(d, t, "en", "web", len(t)) for d, t in docs]
    found = got(decontam.contained_items(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(texts, "item_id long, text string")))
    assert found == brute(docs, texts) and len(found) >= len(items)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(docs, bench).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f", "en", "web", 11)], SCHEMA)
    assert decontam.contained_items(some, bench).collect() == []
    assert decontam.clean_documents(some, bench).count() == 1


def test_every_length_of_item_in_long_documents(spark):
    """Items of 1 to 10 shingles, beside one of 400, each whole in a document of 2 000 words."""
    rnd = random.Random(19)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, prose(5 + i % 10)) for i in range(300)] + [(1000, prose(404))]
    docs = []
    for i, item in items:
        place = rnd.randrange(1900)
        docs.append((i, " ".join(prose(place) + item + prose(2000 - place))))
    rows = [(d, t, "en", "web", len(t)) for d, t in docs]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontam.contained_items(spark.createDataFrame(rows, SCHEMA).repartition(4), bench).collect()
    whole = {(r.doc_id, r.item_id) for r in found}
    assert sum((i, i) in whole for i, _ in items) >= 0.99 * len(items)
