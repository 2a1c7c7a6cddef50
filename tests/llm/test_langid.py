import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from recordloom.llm import langid
from recordloom.llm.queries import op1_language_id
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet").select(["doc_id", "lang"]).to_pylist()}
    found = op1_language_id(spark, folder).collect()
    assert len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out and lang[r.doc_id]]
    right = np.array([r.lang_pred == lang[r.doc_id] for r in held])
    score = np.array([r.score for r in held])
    assert right.mean() > 0.97
    assert abs(score.mean() - right.mean()) < 0.05  # calibrated


def test_odd_rows(spark, small):
    rows = plain_documents(small) + odd_rows()
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    found = langid.identify(docs, langid.fit(langid.training_rows(docs))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (900001, 900002, 900003)] == ["und"] * 3
    assert [by_id[i].score for i in (900001, 900002, 900003)] == [0.0] * 3
    assert all(0 <= r.score <= 1 and r.lang_pred for r in found)


def test_language_of_the_row_is_no_input(spark, small):
    rows = [(i, t, g, s, n) for i, t, g, s, n in plain_documents(small)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(langid.training_rows(docs))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    other = spark.createDataFrame([(i, t, "xx", "yy", 0) for i, t, *_ in rows], SCHEMA)
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(other, model).collect()} == plain


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None, "web", 10), (2, None, "en", "web", 0)], SCHEMA)
    model = langid.fit(langid.training_rows(docs))
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.fit(langid.training_rows(empty))).collect() == []


def test_copies_do_not_thin_out_the_sample(spark):
    rows = spark.range(4000).selectExpr("'one text of many copies' AS text", "'xx' AS lang")
    for lang, n in (("xx", 10), ("yy", 50), ("zz", 3)):
        rows = rows.unionByName(spark.range(n).selectExpr(f"concat('text of {lang} ', id) AS text", f"'{lang}' AS lang"))
    found = langid.fitting_sample(rows, per_language=5).collect()
    assert {x: sorted(r["rank"] for r in found if r.lang == x) for x in ("xx", "yy", "zz")} == {"xx": [1, 2, 3, 4, 5], "yy": [1, 2, 3, 4, 5], "zz": [1, 2, 3]}
    assert len({r.text for r in found}) == 13


def test_one_language(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "web", 10) for i in range(20)], SCHEMA)
    found = langid.identify(docs, langid.fit(langid.training_rows(docs))).collect()
    assert {r.lang_pred for r in found} == {"en"}


def test_elastic_net_leaves_sparse_weights():
    rng = np.random.default_rng(2)
    rows = []
    for y in (0, 1) * 200:
        at = np.unique(np.append(rng.integers(100, 2000, 30), y))
        rows.append((np.append(at, langid.DIMENSION), np.append(np.full(len(at), 0.2), 1.0), y))
    weights = langid.ftrl(rows, 2)
    assert (weights != 0).mean() < 0.1
    assert weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, (4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=row) for row in p])
    assert langid.temperature(logits * 4, y) == pytest.approx(4, rel=0.1)


def dense_ftrl(rows, n_classes, dimension):
    """The same updates written out weight by weight."""
    z, n = np.zeros((dimension + 1, n_classes)), np.zeros((dimension + 1, n_classes))

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * langid.L1) / ((langid.BETA + n[i, k] ** 0.5) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(5)
    for _ in range(langid.EPOCHS):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            w = [[weight(i, k) for k in range(n_classes)] for i in at]
            s = [sum(x[j] * w[j][k] for j in range(len(at))) for k in range(n_classes)]
            p = [np.exp(v - max(s)) for v in s]
            p = [v / sum(p) for v in p]
            for j, i in enumerate(at):
                for k in range(n_classes):
                    g = x[j] * (p[k] - (k == y))
                    sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / langid.ALPHA
                    z[i, k] += g - sigma * w[j][k]
                    n[i, k] += g * g
    return np.array([[weight(i, k) for k in range(n_classes)] for i in range(dimension + 1)])


def test_fit_equals_a_dense_version():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        at = np.append(np.sort(rng.choice(16, 5, replace=False)), 16)
        rows.append((at, np.append(rng.random(5), 1.0), int(rng.integers(3))))
    assert np.allclose(langid.ftrl(rows, 3, dimension=16), dense_ftrl(rows, 3, 16), atol=1e-9)


def test_gram_counts_equal_a_plain_count():
    text = "  Ünïcödé  and\tplain \U0001f600 words "
    at, n = langid.gram_counts(text)
    folded = " " + " ".join(text.lower().split()) + " "
    grams = {}
    for order in langid.ORDERS:
        for i in range(len(folded) - order + 1):
            acc = 0
            for c in folded[i : i + order]:
                acc = (acc * 0x01000193 + ord(c)) & 0xFFFFFFFF
            bucket = (((acc ^ (order * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 17
            grams[bucket] = grams.get(bucket, 0) + 1
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == grams


def test_every_labelled_language_is_kept(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 1 << 18)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = spark.range(1200).selectExpr("concat('text number ', id, ' of language ', id % 600) AS text", "concat('l', id % 600) AS lang")
    model = langid.fit(rows)
    assert len(model.langs) == 600 and len(model.idf) == 256 and model.weights.shape == (257, 600)
