import time
import zlib

import numpy as np
import pyarrow.parquet as pq

from recordloom.llm import toxicity
from recordloom.llm.queries import op2_toxicity
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes


def model_of(words):
    return toxicity.Model({toxicity.fold(w).strip() + " ": 3.0 for w in words}, list(toxicity.EXCEPTIONS))


def test_held_out_precision_and_recall(spark):
    folder = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    found = op2_toxicity(spark, folder).collect()
    assert len(found) == pq.read_table(f"{folder}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    held = [(r.predicted, toxic[r.doc_id]) for r in found if r.held_out and r.doc_id in toxic]
    hits = sum(p and y for p, y in held)
    assert hits / max(1, sum(p for p, _ in held)) > 0.9
    assert hits / sum(y for _, y in held) > 0.8


def test_disguises_are_folded():
    m = model_of(["idiot", "trash", "loser"])
    for text in ("You 1d10t", "іdіоt", "IDIOT!", "ÌDÍÖT", "tr@sh", "ｔｒａｓｈ", "l0ser", "1oser", "$ such trash $"):
        assert m.matches(text)[1] == 1, text
    for text in ("idiotic", "trashing", "losers", "a closer look"):
        assert m.matches(text)[1] == 0, text


def test_exceptions_are_spared():
    m = model_of(["clown", "trash"])
    assert m.matches("a clown fish by the trash can")[1] == 0
    assert m.matches("a clown fish and a clown")[1] == 1


def test_longer_texts_need_more_matches():
    m = model_of(["clown"])
    m.rate = 0.02
    short, long = "you clown " + "word " * 20, "you clown " + "word " * 500
    assert m.raw(short)[0] > m.raw(long)[0]


def test_odd_rows(spark, small):
    rows = plain_documents(small) + odd_rows()
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    labels = spark.createDataFrame([(r[0], 0, int(k % 9 == 0)) for k, r in enumerate(rows)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, toxicity.training_labels(labels))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    empties = {r.score for r in found if r.doc_id in (900001, 900002, 900003)}
    assert len(empties) == 1


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "en", "web", 9), (2, "some words", "en", "web", 10)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert found[1].score > found[2].score and found[2].predicted == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []


def test_curve_finds_a_floor():
    rng = np.random.default_rng(6)
    x = rng.uniform(-10, 10, 6000)
    p = 0.02 + 0.98 / (1 + np.exp(-(1.2 * x - 3)))
    y = (rng.random(6000) < p).astype(float)
    slope, shift, floor = toxicity.curve(x, y, np.ones(6000))
    assert abs(slope - 1.2) < 0.25 and abs(shift + 3) < 0.7 and 0.005 < floor < 0.04


def naive(model, text):
    """Matches by looking for every entry at every word, word by word."""
    total = n = 0
    variants = [toxicity.fold(text)] + ([] if text.isascii() else [toxicity.fold(text, True)])
    fixed = {toxicity.fold(w).strip() + " " for w in toxicity.FIXED}
    size = len(variants[0])
    covered, best = set(), {}
    for k, folded in enumerate(variants):
        for phrase in model.exceptions:
            own = toxicity.fold(phrase)
            for at in range(size):
                if folded.startswith(own, at):
                    covered.update(range(at, at + len(own) - 1))
        for entry, weight in model.weights.items():
            if k and entry not in fixed:
                continue
            for at in range(size):
                if folded.startswith(" " + entry, at):
                    best[at] = max(best.get(at, 0.0), weight)
    for at, weight in best.items():
        if at not in covered:
            total, n = total + weight, n + 1
    return total, n, len(variants[0].split())


def test_matches_equal_a_naive_scan():
    rng = np.random.default_rng(8)
    words = ["idiot", "trash", "can", "clown", "fish", "1d10t", "tràsh", "guinea", "pig", "pigs", "iron", "x", "scum", "idiotic", "ID1OT"]
    m = toxicity.Model({"idiot ": 3.0, "trash ": 2.5, "ciown ": 1.5, "pig ": 2.0, "idio": 1.0, "scu": 4.0}, list(toxicity.EXCEPTIONS) + ["x trash"])
    m.weights = {toxicity.fold(k.strip()).strip() + (" " if k.endswith(" ") else ""): v for k, v in m.weights.items()}
    for _ in range(200):
        text = " ".join(rng.choice(words, rng.integers(0, 30)).tolist())
        got, want = m.matches(text), naive(m, text)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9, text


def test_many_exceptions_take_time_in_proportion():
    m = model_of(["trash"])
    start = time.monotonic()
    assert m.matches("trash can " * 100_000 + "trash")[1] == 1
    assert time.monotonic() - start < 10


def test_exceptions_are_learned_from_clean_texts(spark):
    rows, labels = [], []
    for k in range(120):
        rows.append((k, f"you word{k} zorgle, go home{k} zorgle", "en", "web", 0))
        labels.append((k, 0, 1))
        rows.append((1000 + k, f"plain words number {k} of a text" + (f" with zorgle bread {k}" if k % 10 == 0 else ""), "en", "web", 0))
        labels.append((1000 + k, 0, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert toxicity.fold("zorgle bread").strip() in m.exceptions
    assert m.matches("a zorgle bread")[1] == 0 and m.matches("a zorgle")[1] > 0
