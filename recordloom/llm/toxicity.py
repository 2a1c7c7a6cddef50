"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, look-alike letters and digit substitutions become plain letters, and i, l and 1 one
letter. Lexicon entries are whole words or word beginnings; each weighs the logarithm of how much more often it
stands in toxic than in other texts of a bounded sample of labelled rows, joined by a short fixed list with prior
counts. A match inside an exception phrase does not count. The sum of weights less what a toxic text of that length
would hold of matches becomes a probability by a fitted logistic curve.

Two words that texts of label 0 hold together with a match, and no text of label 1, become an exception phrase.

Scale. Labels are sampled before texts are read: at most SAMPLE rows of each label, whose ids are sent to
the tasks, so no text is shuffled to learn from it. Words are counted by distinct predecessors, so that repeated
lines and copies count once. Scoring is a map over whole texts with an automaton of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import materialize, received, sent_to_tasks
from recordloom.llm.langid import held_out

SAMPLE = 8000  # rows of each label at most that the lexicon and the curve are learned from
MIN_CONTEXTS = 4  # different words before an entry in toxic texts
MIN_RATIO = 4.0  # of an entry's frequency in toxic texts to that in others
MIN_GAIN = 12.0  # log-likelihood by which an entry tells toxic texts from others
MOST_WEIGHT = 6.0
SHORTEST, LONGEST = 3, 16  # characters of a word beginning
FIXED_WEIGHT = 3.0  # at least, of the words of the fixed list unless labels speak against them
CLIP = 15.0  # of a text's sum in the curve
THRESHOLD = 0.7

# Words that count as toxic before any label is seen, each as if it had PRIOR occurrences in toxic texts.
FIXED = (
    "asshole bastard bitch bullshit clown coward crap cretin cunt dickhead disgusting dumbass dumb fag filth fool freak garbage "
    "idiot idiotic imbecile jackass jerk kys loser lowlife moron moronic motherfucker nazi nigger pathetic pig retard retarded "
    "scum scumbag shit slut stupid subhuman trash vermin whore worthless"
).split()
PRIOR = 2.0
# Phrases whose words are not meant as abuse; more are learned from texts of label 0.
EXCEPTIONS = (
    "class clown|clown fish|circus clown|trash can|trash bin|trash bag|garbage collection|garbage collector|garbage truck|guinea pig|"
    "pig iron|control freak|fool proof|idiot proof|dumb waiter|dumb terminal|fools gold"
).split("|")
LEAST_CLEAN = 3  # sampled texts of label 0, and none of label 1, that make two words an exception
# Look-alike letters of other scripts.
LOOK_ALIKES = dict(zip("аеорсхуіѕјһкмтвнԁԛԝαοειкνρτυωɑɡıℓ", "aeopcxyisjhkmtbhdqwaoeiknptuwagil", strict=True))
# Digits and signs read as letters.
DIGITS = dict(zip("013457892", "oieastbgz", strict=True))
SIGNS = {"@": "a", "$": "s"}
_SIGN = re.compile(r"(?<![@$])[@$](?=[^\W\d_])")


def fold_table(accents: bool) -> dict[int, str]:
    """For str.translate on lower-cased text: letters to plain letters, all else of ASCII to a space.

    ``accents`` tells whether accented Latin letters become plain too. Every character becomes one character.
    """
    table: dict[int, str] = {}
    for code in [*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(code).lower())
        if plain[:1].isascii() and plain[:1].isalnum() and (accents or code >= 0xFF01):
            table[code] = plain[0]
    table |= {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(a): b for a, b in DIGITS.items()}
    table |= {c: " " for c in range(128) if not chr(c).isalnum()}
    for code in [ord("l"), *table]:
        if table.get(code, chr(code)) == "l":
            table[code] = "i"
    return table


_FOLD, _PLAIN = fold_table(False), fold_table(True)


def fold(text: str, accents: bool = False) -> str:
    """The text in plain letters, words separated by spaces, with a space at each end."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_PLAIN if accents else _FOLD)} "


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``size`` labelled rows of each label, by the order of a hash of the id."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    some = None
    for label in (0, 1):
        own = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        some = own if some is None else some.unionByName(own)
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("text", "toxic").distinct()


def _contexts(sample: DataFrame) -> DataFrame:
    """``toxic, word, n``: before how many different words each word of the sample's texts stands, by label."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                pairs = sorted(set(zip(["", *words], words, strict=False)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": pa.array([toxic] * len(pairs), pa.int32()), "before": pa.array([x[0] for x in pairs], pa.string()),
                        "word": pa.array([x[1] for x in pairs], pa.string()),
                    }
                )

    pairs = sample.select("text", "toxic").mapInArrow(cut, "toxic int, before string, word string").distinct()
    return pairs.groupBy("toxic", "word").agg(F.count("*").alias("n"))


def _entries(words: DataFrame) -> DataFrame:
    """``entry, a, b``: occurrences in toxic and in other texts of every word beginning and every whole word."""
    lengths = F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.char_length("word"))))
    beginnings = F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))
    named = F.when(F.char_length("word") >= SHORTEST, F.concat(beginnings, F.array(F.concat("word", F.lit(" "))))).otherwise(F.array(F.concat("word", F.lit(" "))))
    rows = words.select("toxic", "n", F.explode(named).alias("entry"))
    return rows.groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))


class Model:
    """Entries with weights, exception phrases, and the curve from a text's sum to a probability."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], rate: float = 0.0, slope: float = 1.0, shift: float = 0.0, floor: float = 0.0):
        self.weights, self.exceptions, self.rate = weights, exceptions, rate
        self.slope, self.shift, self.floor = slope, shift, floor
        self.automaton = self.plain = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "plain": None}

    def matchers(self):
        """The automaton of all entries, and that of the fixed words, for texts whose accents are taken away."""
        if self.automaton is None:
            fixed = {fold(w).strip() + " " for w in FIXED}
            self.automaton, self.plain = ahocorasick.Automaton(), ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                for into in (self.automaton, self.plain) if entry in fixed else (self.automaton,):
                    into.add_word(" " + entry, (len(entry) + 1, weight))
            for phrase in self.exceptions:
                for into in (self.automaton, self.plain):
                    into.add_word(fold(phrase), (len(fold(phrase)), None))
            for each in (self.automaton, self.plain):
                if len(each):
                    each.make_automaton()
        return self.automaton, self.plain

    def matches(self, text: str) -> tuple[float, int, int]:
        """The sum of weights, the number of matches and of words. A word counts once, by its heaviest entry."""
        folded = fold(text)
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for matcher, own in zip(self.matchers(), (folded, None if text.isascii() else fold(text, True)), strict=True):
            if own is None or not len(matcher):
                continue
            for end, (size, weight) in matcher.iter(own):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    at[start] = max(at.get(start, 0.0), weight)
        if spared:
            covered = merged(spared)
            begins = [a for a, _ in covered]

            def is_spared(start: int) -> bool:
                k = bisect_right(begins, start) - 1
                return k >= 0 and start < covered[k][1]

            at = {start: w for start, w in at.items() if not is_spared(start)}
        return sum(at.values()), len(at), len(folded.split())

    def pairs(self, text: str) -> set[str]:
        """Each matched word of the folded text with the word before and with the word behind it."""
        folded = fold(text)
        starts = {end - size + 1 for end, (size, weight) in self.matchers()[0].iter(folded) if weight is not None} if len(self.matchers()[0]) else set()
        out: set[str] = set()
        at, words = 0, folded.split(" ")
        hits = []
        for word in words:
            hits.append(bool(word) and at - 1 in starts)
            at += len(word) + 1
        full = [(w, h) for w, h in zip(words, hits, strict=True) if w]
        for (a, hit_a), (b, hit_b) in zip(full, full[1:], strict=False):
            if hit_a or hit_b:
                out.add(f"{a} {b}")
        return out

    def raw(self, text: str) -> tuple[float, int]:
        """The sum of weights less what a toxic text of this length has of matches, and the number of matches."""
        total, n, words = self.matches(text)
        return float(np.clip(total - self.rate * words, -CLIP, CLIP)), n

    def probability(self, raw: float) -> float:
        return float(self.floor + (1 - self.floor) / (1 + np.exp(-(self.slope * raw + self.shift))))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ordered spans without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and floor of the likeliest curve floor + (1 - floor) * logistic(slope * x + shift).

    The floor takes up texts labelled 1 that no word explains, so that they don't flatten the slope. A grid over
    sums rounded to twentieths is searched, then refined twice.
    """
    at = np.rint((x + CLIP) * 20).astype(int)
    size = int(40 * CLIP) + 1
    ones, zeros = (np.bincount(at, weights=weight * w, minlength=size) for w in (y, 1 - y))
    centers = np.arange(size) / 20 - CLIP

    def likelihood(slope: float, shift: float, floor: float) -> float:
        p = np.clip(floor + (1 - floor) / (1 + np.exp(-np.clip(slope * centers + shift, -30, 30))), 1e-6, 1 - 1e-6)
        return float((ones * np.log(p) + zeros * np.log(1 - p)).sum())

    slopes, shifts, floors = np.geomspace(0.1, 3, 16), np.linspace(-10, 4, 29), np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04])
    best = (1.0, -3.0, 0.0)
    for step in (1.0, 0.25, 0.0625):
        best = max(((a, b, c) for a in slopes for b in shifts for c in floors), key=lambda v: likelihood(*v))
        slopes, shifts = best[0] * np.exp(np.linspace(-0.25, 0.25, 9) * step), best[1] + np.linspace(-0.5, 0.5, 9) * step
        floors = np.clip(best[2] * np.exp(np.linspace(-0.5, 0.5, 5) * step), 0, 0.5)
    return tuple(float(v) for v in best)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows; both sides hold the rows it may learn from and no others."""
    sample = materialize(sampled(docs, labels))
    rates = {r.toxic: r.n for r in labels.where("toxic IS NOT NULL").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    scale = {k: rates[k] / sizes[k] for k in sizes}  # labelled rows each sampled text stands for
    words = materialize(_contexts(sample))
    totals = {r.toxic: r.n for r in words.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    fixed = {fold(w).strip() + " " for w in FIXED}
    entries = materialize(_entries(words))
    both = (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    gained = F.col("a") * F.log(F.col("a") / n1 / both) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n0 / both)).otherwise(0.0)
    often = entries.where(F.col("a") >= MIN_CONTEXTS).where(F.col("a") / n1 >= MIN_RATIO * (F.col("b") + 0.5) / n0).where(gained >= MIN_GAIN * 0.999)
    found = {r.entry: (r.a, r.b) for r in often.collect()}  # entries that tell the labels of a bounded sample apart
    known = {r.entry: (r.a, r.b) for r in entries.where(F.col("entry").isin(sorted(fixed))).collect()}

    def weight_of(a: float, b: float) -> float:
        return float(min(MOST_WEIGHT, np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0)))

    def gain(a: float, b: float) -> float:
        """Log-likelihood of the entry's occurrences with a rate for each label over that with one rate."""
        both = (a + b) / (n1 + n0)
        return a * np.log(max(a, 1e-9) / n1 / both) + b * np.log(max(b, 1e-9) / n0 / both)

    weights: dict[str, float] = {}
    heads: set[str] = set()  # beginnings of the entries so far
    for entry, (a, b) in sorted(found.items(), key=lambda x: (-round(gain(*x[1]), 6), -len(x[0]), x[0])):
        if gain(a, b) < MIN_GAIN:
            break
        if entry not in heads and not any(entry[:k] in weights for k in range(SHORTEST, len(entry))):
            weights[entry] = weight_of(a, b)
            heads.update(entry[:k] for k in range(SHORTEST, len(entry)))
    for entry in sorted(fixed):
        a, b = known.get(entry, (0, 0))
        if (w := weight_of(a + PRIOR, b)) > 0:
            weights[entry] = max(w, FIXED_WEIGHT if not b else w, weights.get(entry, 0.0))
    model = Model(weights, list(EXCEPTIONS))
    model.exceptions += [x for x in learned_exceptions(sample, model) if x not in model.exceptions]
    model.automaton = model.plain = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.matches(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch.column("toxic"), "x": pa.array([x[0] for x in out], pa.float64()), "n": pa.array([x[1] for x in out], pa.int64()), "words": pa.array([x[2] for x in out], pa.int64())}
            )

    rows = sample.mapInArrow(measure, "toxic int, x double, n long, words long").toArrow()  # 2 * SAMPLE rows at most
    x, y, n, words_ = (np.array(rows.column(c), float) for c in ("x", "toxic", "n", "words"))
    if len(set(y)) == 2:
        # matches of a word: the median over toxic texts, less the mean over others
        share = n / np.maximum(words_, 1)
        model.rate = float(max(0.0, np.median(share[y > 0]) - n[y == 0].sum() / max(1.0, words_[y == 0].sum())))
        weight = np.where(y > 0, scale.get(1, 1), scale.get(0, 1)) / sum(rates.values()) * len(x)
        model.slope, model.shift, model.floor = curve(np.clip(x - model.rate * words_, -CLIP, CLIP), y, weight)
    else:
        model.slope, model.shift = 1.0, -3.0
    return model


def learned_exceptions(sample: DataFrame, model: Model) -> list[str]:
    """Pairs of successive words with an entry's match that LEAST_CLEAN texts of label 0 hold and no text of label 1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                pairs = sorted(model.pairs(text))
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(pairs), pa.int32()), "phrase": pa.array(pairs, pa.string())})

    pairs = sample.select("text", "toxic").mapInArrow(cut, "toxic int, phrase string").groupBy("phrase").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.count("*").alias("n"))
    return sorted(r.phrase for r in pairs.where(f"a = 0 AND n >= {LEAST_CLEAN}").collect())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, matches`` for every row: the probability of label 1 from the whole text alone.

    Null and empty texts have no match and the score of a text without one. Repeated rows get equal results; an empty
    table gives no rows. Columns beside ``doc_id, text`` play no part.
    """
    shared = sent_to_tasks(docs.sparkSession, model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shared)
        for whole in batches:
            for batch in tb.pieces(whole):
                raws = [m.raw(t or "") for t in batch.column("text").to_pylist()]
                scores = [m.probability(x) for x, _ in raws]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()),
                        "predicted": pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), "matches": pa.array([n for _, n in raws], pa.int32()),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rate, "doc_id long, score double, predicted int, matches int")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels a model may learn from: those whose id's checksum modulo 3 is not 1."""
    return labels.where(~held_out("doc_id", 3, 1))
