import hashlib
import random

import numpy as np
import pytest

from recordloom.llm import common
from recordloom.llm import suffixdedup as sd
from recordloom.llm.queries import removal_digests
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes

KIND = "doc_id long, text string"


def brute(rows, length=100):
    """Removed bytes by a dictionary of all strings: the least id of each, and its first place in each text."""
    texts = [(-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least, own = {}, {}
    for i, raw in set(texts):
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, i), i)
            own.setdefault((s, i, raw), p)
    out = []
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if least[s] < i or own[s, i, raw] < p:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)) == 1)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((None if i == -(1 << 63) else i, len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    return sorted(map(tuple, removal_digests(sd.deduplicate(df, **options)).collect()), key=str)


def planted(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = prose(60), prose(12)
    rows = [(i, prose(rnd.randint(5, 120))) for i in range(60)]
    rows += [(100 + i, f"{prose(20)} {passage} {prose(20)}") for i in range(12)]
    rows += [(200 + i, f"{prose(15)}\n{line}\n{prose(15)}") for i in range(12)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    rows += [(400 + i, rows[i + 60][1][: 200 + i] + "x" + rows[i + 60][1][200 + i :]) for i in range(10)]
    rows += [(500, "ab" * 400), (501, "of " * 300), (502, "x" * 99), (503, "y" * 100), (504, "y" * 101), (505, (prose(30) + "\n") * 4)]
    rows += [(506, "é" * 120), (507, "zé" * 70)]
    return rows


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        parts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8) + np.uint8(1)
        words = sd.words_at(np.concatenate([text, np.zeros(200, np.uint8)]), len(text) + 112)
        order = sd.two_stage_suffix_array(text, 104, words)
        suffixes = [text.tobytes()[i:].split(b"\0")[0] for i in order]
        assert sorted(order.tolist()) == list(range(len(text)))
        assert suffixes == sorted(suffixes)


def test_first_least():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 7, 61):
        v = rng.integers(0, 5, 200).astype(np.uint64)
        assert sd.first_least(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(len(v) - width + 1)]


@pytest.mark.parametrize("group", [sd.GROUP, 3])
def test_planted_repeats_match_brute_force(spark, group):
    rows = planted()
    assert run(spark, rows, group=group) == brute(rows)


@pytest.mark.parametrize("group", [1, 20])
def test_large_groups_are_no_row_for_each_string(spark, monkeypatch, group):
    """Lines in ever different surroundings, some of them equal on one side, are settled in a few rows a context."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    line, sides = prose(22)[:103], [prose(30) for _ in range(3)]
    rows = [(i, f"{rnd.choice(sides)[:rnd.randint(20, 160)] if i % 3 == 0 else prose(20)}{line[i % 7 :]}{rnd.choice(sides) if i % 3 == 1 else prose(20)}") for i in range(90)]
    rows += [(7, rows[20][1] + prose(9)), (95, line[:80] + rows[31][1] + line)]
    sizes = []

    def counted(df):
        out = common.written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(sd, "written", counted)
    monkeypatch.setattr(common, "HOT", 3)
    assert run(spark, rows, group=group) == brute(rows)
    assert max(sizes) * 8 < sum(len(r[1].encode()) for r in rows)


def test_joins_in_place_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rows = planted(5)
    assert run(spark, rows) == brute(rows)


def test_whole_small_table_and_odd_rows(spark, small):
    rows = plain_documents(small) + [r for r in odd_rows() if r[0] != 900005]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, removal_digests(sd.deduplicate(df)).collect()), key=str) == brute([r[:2] for r in rows])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_blocks_of_long_texts(spark, monkeypatch):
    rows = planted(9)
    rows.append((600, " ".join(r[1] for r in rows[:80])))
    monkeypatch.setattr(sd, "PIECE", 500)
    assert run(spark, rows) == brute(rows)


def test_texts_that_share_an_id(spark):
    """Two texts of one id are no earlier than one another, and spans of one are not applied to the other."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(1, passage + " " + prose(30)), (5, prose(40) + " " + passage), (5, prose(90)), (6, prose(50)), (5, passage + "z" + prose(5)), (7, passage + "y")]
    rows += [(0, prose(20) + passage[:150] + prose(9)), (0, passage[:150] + prose(20)), (None, prose(30)), (None, prose(20)), (5, rows[1][1])]
    for group in (sd.GROUP, 1):
        assert run(spark, rows, group=group) == brute(rows)


def test_a_long_text_of_repeated_lines(spark):
    row = next(r for r in odd_rows() if r[0] == 900005)[:2]
    rows = [row, (3, row[1][:5000]), (900009, row[1][7:300])]
    assert run(spark, rows) == brute(rows)


def test_what_is_kept_and_removed(spark):
    rows = planted(4)
    for r in sd.deduplicate(spark.createDataFrame(rows, KIND)).collect():
        raw = next(t for i, t in rows if i == r.doc_id).encode()
        kept, last = b"", 0
        for s in r.removed:
            kept, last = kept + raw[last : s.start], s.end
        assert bytes(r.kept) == kept + raw[last:]
