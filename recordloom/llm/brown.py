"""Language-model scores from a Brown class model: P(w | v) = P(class(w) | class(v)) P(w | class(w)).

Word counts and class-transition counts cover every training text. Exchange clustering (Brown et al. 1992;
Martin et al. 1998) moves words between classes as long as the class-bigram likelihood grows: first one after another
among the most frequent words, then, as in its distributed form (Uszkoreit and Brants 2008), all words of the head that
occur LEAST_COUNT times, at once in each sweep, from counts of their neighbours' classes. Any other word belongs to the
unit of its ending, which is clustered like a word. Transitions are smoothed towards class frequencies, emissions by absolute
discounting, whose mass goes to unknown words.

Scale. Counts are added up in each task before they are shuffled. The first clustering sees a table of CORE by CORE
counts; a sweep over all units is an aggregation of (unit, neighbour's class) counts, whose rows are at most HEAD times
the classes, whatever the corpus. Counts and classes of the HEAD most frequent words travel to the tasks; all other
words meet their counts in a join on the word, so a frequent word is never a hot key of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import materialize, received, sent_to_tasks, written
from recordloom.llm.langid import held_out

HEAD = 1 << 18  # most frequent words, whose counts and units travel to the tasks
LEAST_COUNT = 5  # occurrences that make a word of the head a unit of its own; fewer say little about its class
ENDINGS = 256  # units of all other words
FREQUENT = 767  # most frequent words that are clustered one after another, to begin with
CORE = 1 + ENDINGS + FREQUENT  # units of that first clustering: the end (0), endings, frequent words
CLASSES = 64  # and class 0, which holds the end alone
ROUNDS = 12  # of the first clustering at most
SWEEPS = 1  # over all units
TALLY = 1 << 21  # different keys that a task adds up before it hands them on
ALPHA = 0.1  # added to every count of the base score
PULL = 5.0  # weight of class frequencies in a transition
PIECE = 1 << 20
END_KEY = -0x61C8864680B583EB  # the end's key; no word's hash is treated apart from it


def word_table() -> np.ndarray:
    """White space separates, A-Z become a-z; a NUL byte is part of a word."""
    table = tb.spaced_words()
    table[0] = 255
    return table


def read_words(batch: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending (0 to ENDINGS - 1) and text of every word."""
    data, at = tb.utf8(batch.column("text"))
    folded, starts, ends, doc = tb.word_spans(data, at, table)
    last = folded[ends - 1].astype(np.int64)
    other = np.where(ends - starts > 1, folded[np.maximum(ends - 2, 0)].astype(np.int64), 0)
    return tb.word_hashes(folded, starts, ends), (last * 37 + other * 101) % ENDINGS, doc


def vocabulary(train: DataFrame) -> DataFrame:
    """``w, ending, n``: the count of every word and of the end over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = word_table(), 0
        for whole in batches:
            for batch in tb.pieces(whole, size=2 * PIECE):
                texts += len(batch)
                hashes, ending, _ = read_words(batch, table)
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"w": pa.array(keys.view(np.int64)), "ending": pa.array(ending[first], pa.int32()), "n": pa.array(n.astype(np.int64))}
                )
        yield pa.RecordBatch.from_pydict({"w": pa.array([END_KEY], pa.int64()), "ending": pa.array([-1], pa.int32()), "n": pa.array([texts], pa.int64())})

    found = train.select("text").mapInArrow(count, "w long, ending int, n long")
    return found.groupBy("w").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")).where("n > 0")


def units_of(hashes: np.ndarray, ending: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Unit of every word: 0 is the end, then the endings, then the words of ``own`` (sorted keys)."""
    if not len(own):
        return ending + 1
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    return np.where(own[at] == hashes, at + 1 + ENDINGS, ending + 1)


def with_ends(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' values in one row, each between zeros (ends), and the text of every element after the first."""
    row = np.zeros(len(values) + n_docs + 1, np.int64)
    row[np.arange(len(values)) + doc + 1] = values
    words = np.bincount(doc, minlength=n_docs)
    return row, np.repeat(np.arange(n_docs), words + 1)


def transitions(train: DataFrame, own: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How often a group of units follows a group, over all training texts; ``group`` of every unit."""
    shared = sent_to_tasks(train.sparkSession, (own, group))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = word_table(), np.zeros(groups * groups, np.int64)
        keys, of = received(shared)
        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                hashes, ending, doc = read_words(batch, table)
                row, _ = with_ends(of[units_of(hashes, ending, keys)], doc, len(batch))
                total += np.bincount(row[:-1] * groups + row[1:], minlength=groups * groups)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            at = some[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = train.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # groups squared at most
    out = np.zeros(groups * groups, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(groups, groups)


class Tally:
    """Counts of 64-bit keys, added up while they are few enough to be held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > 2 * TALLY:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(n, first) if len(first) else n


def neighbour_counts(train: DataFrame, own: np.ndarray, of: np.ndarray, k: int) -> DataFrame:
    """``unit, slot, n``: how often a class follows a unit (slot = class), precedes it (k + class), and how often the unit
    follows itself (2 k)."""
    shared = sent_to_tasks(train.sparkSession, (own, of))
    slots = 2 * k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tally = word_table(), Tally()
        keys, classes = received(shared)

        def told() -> Iterator[pa.RecordBatch]:
            found, n = tally.total()
            for at in range(0, len(found), 100_000):
                own = slice(at, at + 100_000)
                yield pa.RecordBatch.from_pydict(
                    {"unit": pa.array(found[own] // slots, pa.int32()), "slot": pa.array(found[own] % slots, pa.int32()), "n": pa.array(n[own], pa.int64())}
                )
            tally.parts, tally.size = [], 0

        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                hashes, ending, doc = read_words(batch, table)
                row, _ = with_ends(units_of(hashes, ending, keys), doc, len(batch))
                u, v = row[:-1], row[1:]
                tally.add(np.concatenate([u * slots + classes[v], v * slots + k + classes[u], u[u == v] * slots + 2 * k]))
                if tally.size > TALLY:
                    yield from told()
        yield from told()

    return train.select("text").mapInArrow(count, "unit int, slot int, n long").groupBy("unit", "slot").agg(F.sum("n").alias("n"))


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """Class-bigram log-likelihood, but for a part that classes don't change."""
    return float(plogp(joint).sum() - plogp(joint.sum(axis=0)).sum() - plogp(joint.sum(axis=1)).sum())


def gains(joint: np.ndarray, class_out: np.ndarray, class_in: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """Change of the likelihood if a unit joins each class, none for class 0.

    ``joint`` lacks the unit's pairs, the sums of its class lack the unit; ``after`` and ``before`` count the classes
    around it but for itself, ``own`` how often it follows itself. Only classes that occur around the unit are looked at.
    """
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    rows = plogp(joint[:, a] + after[a]) - plogp(joint[:, a])
    columns = plogp(joint[b] + before[b, None]) - plogp(joint[b])
    gain = rows.sum(axis=1) + columns.sum(axis=0)
    gain[a] -= rows[a, np.arange(len(a))]
    gain[b] -= columns[np.arange(len(b)), b]
    corner = joint.diagonal()
    gain += plogp(corner + after + before + own) - plogp(corner)
    out, in_ = after.sum() + own, before.sum() + own
    gain -= plogp(class_out + out) - plogp(class_out) + plogp(class_in + in_) - plogp(class_in)
    gain[0] = -np.inf
    return gain


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = ROUNDS) -> np.ndarray:
    """Class of every unit by exchange clustering of a unit-bigram table; unit 0 stays alone in class 0.

    A unit moves to the class that raises the class-bigram log-likelihood most; sweeps go over units by
    frequency until none moves. Ties go to the smaller class.
    """
    n_units = len(pairs)
    total = pairs.sum(axis=1)
    order = np.argsort(-total[1:], kind="stable") + 1
    of = np.zeros(n_units, np.int64)
    of[order] = 1 + np.minimum(np.arange(len(order)), classes - 1)
    k = classes + 1
    member = np.zeros((n_units, k))
    member[np.arange(n_units), of] = 1
    table = pairs.astype(np.float64)
    after, before = table @ member, table.T @ member  # of a unit: what class follows, what class precedes
    joint = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for u in order[total[order] > 0]:
            a, own = of[u], table[u, u]
            r, le = after[u].copy(), before[u].copy()
            r[a] -= own
            le[a] -= own
            g = without(joint, a, r, le, own)
            class_out, class_in = joint.sum(axis=1), joint.sum(axis=0)
            class_out[a] -= r.sum() + own
            class_in[a] -= le.sum() + own
            gain = gains(g, class_out, class_in, r, le, own)
            b = int(gain.argmax())
            if b != a and gain[b] > gain[a] + 1e-9:
                g[b] += r
                g[:, b] += le
                g[b, b] += own
                joint = g
                after[:, a] -= table[:, u]
                after[:, b] += table[:, u]
                before[:, a] -= table[u]
                before[:, b] += table[u]
                of[u] = b
                moved += 1
        if not moved:
            break
    return of


def without(joint: np.ndarray, a: int, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """The class table without a unit of class ``a``."""
    g = joint.copy()
    g[a] -= after
    g[:, a] -= before
    g[a, a] -= own
    return g


def best_classes(joint: np.ndarray, around: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The best class of each of several units, one by one against the same table, as ``gains`` of a single unit tells.

    A unit's row of ``around`` counts the classes behind and before it and how often it follows itself.
    """
    k = len(joint)
    each = np.arange(len(of))
    own = around[:, 2 * k]
    after, before = around[:, :k].copy(), around[:, k : 2 * k].copy()
    after[each, of] -= own
    before[each, of] -= own
    gain = np.zeros((len(of), k))
    for side, other, table in ((after, before, joint.T), (before, after, joint)):
        u, c = np.nonzero(side)
        by, a = side[u, c], of[u]
        # the class c's cells of the table without the unit; the unit's own class lacks its row and column
        cells = table[c].copy()
        within = np.flatnonzero(c == a)
        cells[within] -= other[u[within]]
        cells[within, a[within]] -= own[u[within]]
        cells[np.arange(len(u)), a] -= by
        change = plogp(cells + by[:, None]) - plogp(cells)
        change[np.arange(len(u)), c] = 0  # the corner of a class with itself comes below
        np.add.at(gain, u, change)
    corner = np.repeat(joint.diagonal()[None, :], len(of), axis=0)
    corner[each, of] -= after[each, of] + before[each, of] + own
    gain += plogp(corner + after + before + own[:, None]) - plogp(corner)
    for side, total in ((after, joint.sum(axis=1)), (before, joint.sum(axis=0))):
        size = side.sum(axis=1) + own
        left = np.repeat(total[None, :], len(of), axis=0)
        left[each, of] -= size
        gain -= plogp(left + size[:, None]) - plogp(left)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[each, best] > gain[each, of] + 1e-9, best, of)


def moves(counts: DataFrame, joint: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The best class of every unit against the classes of all others, from ``unit, slot, n``; units without a count stay."""
    k = len(joint)
    shared = sent_to_tasks(counts.sparkSession, (joint.astype(np.float64), of))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, classes = received(shared)
        for batch in batches:
            for first in range(0, len(batch), 512):
                some = batch.slice(first, 512)
                units, lists = some.column("unit").to_numpy(), some.column("slots")
                around = np.zeros((len(some), 2 * k + 1))
                slot, n = (lists.flatten().field(x).to_numpy() for x in ("slot", "n"))
                around[np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy()), slot] = n
                yield pa.RecordBatch.from_pydict({"unit": some.column("unit"), "class": pa.array(best_classes(table, around, classes[units]), pa.int32())})

    grouped = counts.where("unit > 0").groupBy("unit").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))  # 2 k + 1 at most
    found = grouped.mapInArrow(best, "unit int, class int").toArrow()  # a row for each unit: HEAD and the endings at most
    out = of.copy()
    out[found.column("unit").to_numpy()] = found.column("class").to_numpy()
    return out


def class_table(counts: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """How often a class follows a class, from ``unit, slot, n``."""
    shared = sent_to_tasks(counts.sparkSession, of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = received(shared), np.zeros(k * k, np.int64)
        for batch in batches:
            at = classes[batch.column("unit").to_numpy()] * k + batch.column("slot").to_numpy()
            np.add.at(total, at, batch.column("n").to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    found = counts.where(F.col("slot") < k).mapInArrow(add, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(k, k)


def clustered(train: DataFrame, own: np.ndarray, own_n: np.ndarray, own_ending: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of every unit, class table): the frequent words one after another, then all units in sweeps.

    Of the classes after each sweep, those of the greatest likelihood stay.
    """
    k = classes + 1
    frequent = np.sort(np.lexsort((own, -own_n))[:FREQUENT])
    core = np.concatenate([[0], 1 + np.arange(ENDINGS), 1 + own_ending])
    core[1 + ENDINGS + frequent] = 1 + ENDINGS + np.arange(len(frequent))
    pairs = transitions(train, own, core, CORE)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"of": exchange(received(shared), classes)})

    # the table is CORE by CORE, and one task clusters it
    shared = sent_to_tasks(train.sparkSession, pairs)
    first = train.sparkSession.range(1).groupBy("id").applyInPandas(cluster, "of long").toPandas()["of"].to_numpy()
    of = first[core]
    best = None
    for sweep in range(sweeps + 1):
        if sweep < sweeps:
            counts = written(neighbour_counts(train, own, of, k))
            joint = class_table(counts, of, k)
        else:
            joint = transitions(train, own, of, k)
        if best is None or likelihood(joint) > likelihood(best[1]):
            best = of, joint
        if sweep < sweeps:
            of = moves(counts, joint, of)
    return best


class Model:
    """Everything a task needs: bounded by HEAD, ENDINGS and CLASSES."""

    def __init__(self, head: np.ndarray, head_n: np.ndarray, head_unit: np.ndarray, of: np.ndarray, step: np.ndarray, discount: float, mass: np.ndarray, kinds: np.ndarray, tokens: int, words: int, ends: int):
        self.head, self.head_n, self.head_unit, self.of, self.step = head, head_n, head_unit, of, step
        self.discount, self.mass, self.kinds, self.tokens, self.words, self.ends = discount, mass, kinds, tokens, words, ends
        self.rest = self.unknown()

    def unknown(self) -> np.ndarray:
        """log10 of the probability of an unknown word in each class."""
        return np.log10(np.maximum(self.discount * np.maximum(self.kinds, 1), 1e-9) / np.maximum(self.mass, 1))

    def find(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, count) of every word; the count of a word that is not in the head is -1."""
        if not len(self.head):
            return ending + 1, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        there = self.head[at] == hashes
        return np.where(there, self.head_unit[at], ending + 1), np.where(there, self.head_n[at], -1)

    def emission(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        known = np.log10(np.maximum(n - self.discount, 1e-9) / np.maximum(self.mass[of], 1))
        return np.where(n > 0, known, self.rest[of])

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ALPHA) / (self.tokens + ALPHA * (self.words + 1)))


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the whole vocabulary of the training texts (null: empty)."""
    words = materialize(vocabulary(train))
    tokens, n_words, ones, twos = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    ends = words.where("ending < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = words.where("ending >= 0").orderBy(F.col("n").desc(), "w").limit(HEAD)
    top = top.select("w", "n", "ending").toArrow()  # HEAD rows at most
    head, head_n, head_ending = (np.array(top.column(x).to_numpy(), np.int64) for x in ("w", "n", "ending"))
    head = head.view(np.uint64)
    order = np.argsort(head)
    head, head_n, head_ending = head[order], head_n[order], head_ending[order]
    often = head_n >= LEAST_COUNT
    of, joint = clustered(train, head[often], head_n[often], head_ending[often])
    unit = units_of(head, head_ending, head[often])
    k = len(joint)
    share = (joint.sum(axis=0) + ALPHA) / (joint.sum() + ALPHA * k)
    step = np.log10((joint + PULL * share[None, :]) / (joint.sum(axis=1, keepdims=True) + PULL))
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    # tokens and kinds of words of each class: the head's by word, all others' by ending
    mass, kinds = np.bincount(of[unit], weights=head_n, minlength=k), np.bincount(of[unit], minlength=k).astype(float)
    in_head = np.bincount(head_ending, weights=head_n, minlength=ENDINGS), np.bincount(head_ending, minlength=ENDINGS)
    for ending, n, n_kinds in words.where("ending >= 0").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        mass[of[1 + ending]] += n - in_head[0][ending]
        kinds[of[1 + ending]] += n_kinds - in_head[1][ending]
    return Model(head, head_n, unit, of, step, discount, mass, kinds, tokens, n_words, ends), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Scores are log10 probabilities of the whole text with its end. A null text is empty: one token, the end.
    Repeated rows get a result each. Nothing learned (no training text) leaves every word unknown; an empty table gives
    no rows. Columns beside ``doc_id, text`` play no part.
    """
    shared = sent_to_tasks(docs.sparkSession, model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = received(shared), word_table()
        row = TaskContext.get().partitionId() << 36
        n_end = np.array([m.ends])
        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                d = len(batch)
                hashes, ending, doc = read_words(batch, table)
                unit, count = m.find(hashes, ending)
                chain, whose = with_ends(m.of[unit], doc, d)
                a = np.bincount(whose, weights=m.step[chain[:-1], chain[1:]], minlength=d)
                b = np.full(d, m.base(n_end)[0])
                known = np.full(d, int(n_end[0] > 0))
                in_head = count >= 0
                if in_head.any():
                    n, own = count[in_head], doc[in_head]
                    a += np.bincount(own, weights=m.emission(n, m.of[unit[in_head]]), minlength=d)
                    b += np.bincount(own, weights=m.base(n), minlength=d)
                    known += np.bincount(own, minlength=d)
                tokens = np.bincount(doc, minlength=d) + 1
                rows = row + np.arange(d)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(rows), "doc_id": batch.column("doc_id"), "w": pa.array(tb.mix(rows).view(np.int64)), "of": pa.array(np.full(d, -1), pa.int32()),
                        "t": pa.array(np.ones(d, int), pa.int32()), "tokens": pa.array(tokens, pa.int64()), "known": pa.array(known, pa.int64()), "a": pa.array(a), "b": pa.array(b),
                    }
                )
                tail = np.flatnonzero(~in_head)
                if len(tail):
                    order = tail[np.lexsort((hashes[tail], doc[tail]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                    first = np.flatnonzero(new)
                    times, at = np.diff(np.append(first, len(order))), order[first]
                    none = np.zeros(len(at))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array(row + doc[at]), "doc_id": pa.nulls(len(at), pa.int64()), "w": pa.array(hashes[at].view(np.int64)), "of": pa.array(m.of[unit[at]], pa.int32()),
                            "t": pa.array(times, pa.int32()), "tokens": pa.array(none.astype(np.int64)), "known": pa.array(none.astype(np.int64)), "a": pa.array(none), "b": pa.array(none),
                        }
                    )
                row += d

    schema = "row long, doc_id long, w long, of int, t int, tokens long, known long, a double, b double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(walk, schema).join(words.select("w", "n"), "w", "left")
    n = F.coalesce("n", F.lit(0))
    tail = F.col("of") >= 0
    masses, rests = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (np.maximum(model.mass, 1), model.rest))
    emitted = F.when(n > 0, F.log10(F.greatest(n - F.lit(float(model.discount)), F.lit(1e-9)) / F.element_at(masses, F.col("of") + 1))).otherwise(F.element_at(rests, F.col("of") + 1))
    base = F.log10((n + F.lit(ALPHA)) / F.lit(float(model.tokens + ALPHA * (model.words + 1))))
    parts = parts.select(
        "row", "doc_id", "tokens",
        F.when(tail, F.when(n > 0, F.col("t")).otherwise(0)).otherwise(F.col("known")).cast("long").alias("known"),
        F.when(tail, F.col("t") * emitted).otherwise(F.col("a")).alias("a"),
        F.when(tail, F.col("t") * base).otherwise(F.col("b")).alias("b"),
    )
    return parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("b").alias("base_score"), F.sum("a").alias("score")
    ).select("doc_id", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def training_rows(docs: DataFrame) -> DataFrame:
    """The texts a model may learn from: those whose id's checksum modulo 10 is not 0."""
    return docs.where(~held_out("doc_id", 10, 0)).select("text")
