import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from recordloom.llm import brown
from recordloom.llm.queries import op10_class_lm
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes


def tokens_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def brute(train, texts):
    counts = Counter(t for text in train for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for text in texts:
        own = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((len(own), sum(counts[t] > 0 for t in own), n, base))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 10 == 0


def check(rows, found):
    expected = brute([r[1] for r in rows if not held_out(r[0])], [r[1] for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    wanted = sorted([(r[0], *e) for r, e in zip(rows, expected, strict=True)], key=key)
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found], key=key)
    assert [w[:4] for w in wanted] == [g[:4] for g in got]
    assert np.allclose([w[4] for w in wanted], [g[4] for g in got], rtol=1e-9)


def test_query_matches_brute_force_and_beats_the_base(spark, small):
    found = op10_class_lm(spark, small).collect()
    check([r[:2] for r in plain_documents(small)], found)
    held = [r for r in found if r.held_out]
    assert len(found) > len(held) > 0
    assert all(r.held_out == held_out(r.doc_id) for r in found)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows_and_words_outside_the_head(spark, small, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 900)
    rows = plain_documents(small) + odd_rows()
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    model, words = brown.fit(brown.training_rows(docs))
    found = brown.score(docs, model, words).collect()
    check([r[:2] for r in rows], found)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_emissions_and_transitions_are_distributions(spark, small):
    docs = spark.createDataFrame(plain_documents(small), SCHEMA)
    model, words = brown.fit(brown.training_rows(docs))
    assert np.allclose((10**model.step).sum(axis=1), 1)
    known = np.zeros(brown.CLASSES + 1)
    pdf = words.where("ending >= 0").toPandas()
    of = model.of[model.find(pdf.w.to_numpy().view(np.uint64), pdf.ending.to_numpy().astype(np.int64))[0]]
    np.add.at(known, of, 10 ** model.emission(pdf.n.to_numpy(), of))
    mass = known + 10**model.rest
    assert (mass[1:][model.mass[1:] > 0] < 1 + 1e-9).all()
    assert np.isclose(model.mass.sum(), pdf.n.sum()) and np.isclose(model.kinds.sum(), len(pdf))


def class_score(model, counts, text):
    """log10 P(text) by the definition, word by word over clear text; classes are the model's, all else is counted anew."""
    table = brown.word_table()

    def unit(word):
        hashes, ending, _ = brown.read_words(pa.RecordBatch.from_pydict({"text": pa.array([word])}), table)
        return int(model.find(hashes, ending)[0][0])

    total, last = 0.0, 0
    for word in [w for w in tokens_of(text) if w is not None]:
        c = int(model.of[unit(word)])
        total += model.step[last, c]
        n = counts.get(word, 0)
        total += math.log10(n - model.discount) - math.log10(model.mass[c]) if n else model.rest[c]
        last = c
    return total + model.step[last, 0]


def test_scores_equal_a_sum_over_clear_text(spark, small):
    rows = plain_documents(small)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, words = brown.fit(brown.training_rows(docs))
    counts = Counter(t for r in rows if not held_out(r[0]) for t in tokens_of(r[1]) if t is not None)
    # transitions, too, are those of the clear text
    of, table, joint = {}, brown.word_table(), np.zeros((brown.CLASSES + 1,) * 2)
    for word in counts:
        hashes, ending, _ = brown.read_words(pa.RecordBatch.from_pydict({"text": pa.array([word])}), table)
        of[word] = int(model.of[model.find(hashes, ending)[0][0]])
    for r in rows:
        if not held_out(r[0]):
            chain = [0, *[of[t] for t in tokens_of(r[1]) if t is not None], 0]
            np.add.at(joint, (chain[:-1], chain[1:]), 1)
    share = (joint.sum(axis=0) + brown.ALPHA) / (joint.sum() + brown.ALPHA * len(joint))
    assert np.allclose(model.step, np.log10((joint + brown.PULL * share) / (joint.sum(axis=1, keepdims=True) + brown.PULL)))
    found = {r.doc_id: r.score for r in brown.score(docs, model, words).collect()}
    for r in rows[:60]:
        assert math.isclose(found[r[0]], class_score(model, counts, r[1]), rel_tol=1e-9)


def test_classes_do_not_depend_on_the_partitions(spark, small):
    docs = spark.createDataFrame(plain_documents(small), SCHEMA)
    one, other = (brown.fit(brown.training_rows(docs.repartition(n)))[0] for n in (1, 5))
    assert (one.of == other.of).all() and np.allclose(one.step, other.step) and (one.head == other.head).all()


def test_sweeps_raise_the_likelihood_and_equal_single_moves():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(0.4, (60, 60)).astype(float)
    pairs[5, 5] = 9
    k = 7
    of = np.concatenate([[0], rng.integers(1, k, 59)])
    member = np.eye(k)[of]
    joint = member.T @ pairs @ member
    around = np.hstack([pairs @ member, pairs.T @ member, pairs.diagonal()[:, None]])
    found = brown.best_classes(joint, around[1:], of[1:])
    for u in range(1, 60):
        values = []
        for c in range(1, k):
            moved = of.copy()
            moved[u] = c
            m = np.eye(k)[moved]
            values.append(brown.likelihood(m.T @ pairs @ m))
        assert math.isclose(values[found[u - 1] - 1], max(values), rel_tol=1e-9)
        r, le, own = around[u, :k].copy(), around[u, k : 2 * k].copy(), around[u, 2 * k]
        r[of[u]] -= own
        le[of[u]] -= own
        g = brown.without(joint, of[u], r, le, own)
        out, in_ = joint.sum(axis=1), joint.sum(axis=0)
        out[of[u]] -= r.sum() + own
        in_[of[u]] -= le.sum() + own
        gain = brown.gains(g, out, in_, r, le, own)
        assert np.allclose(gain[1:] - gain[of[u]], np.array(values) - values[of[u] - 1])


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    pairs = np.zeros((41, 41))
    for _ in range(20_000):
        a = rng.integers(0, 4)
        b = (a + 1) % 4 if rng.random() < 0.9 else rng.integers(0, 4)
        pairs[1 + a * 10 + rng.integers(0, 10), 1 + b * 10 + rng.integers(0, 10)] += 1

    def likelihood(of):
        member = np.eye(5)[of]
        joint = member.T @ pairs @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))

    of = brown.exchange(pairs, classes=4)
    assert likelihood(of) >= likelihood(np.array([0, *np.repeat([1, 2, 3, 4], 10)])) - 1e-6


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model, words = brown.fit(brown.training_rows(docs))
    assert brown.score(docs, model, words).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, words = brown.fit(docs.where("doc_id > 5").select("text"))
    found = sorted(brown.score(docs, model, words).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in found] == [(3, 0, 0), (1, 0, 0)]
