"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (one to three code points of the lower-cased text) are hashed into a fixed table. Document
frequencies count every labelled training document. The model is fitted by follow-the-regularised-leader with
elastic-net penalties (McMahan et al. 2013) on a bounded sample of each language, and a temperature fitted on
held-back rows of that sample calibrates its probabilities.

Scale. Two passes over the texts (frequencies, predictions), each a map; what is aggregated is a table of
DIMENSION counts. The sample is bounded by PER_LANGUAGE rows of each language and SAMPLE_ROWS of all, featurised before
it moves, and fitted in one task; the model has MODEL_CELLS weights at most, and every labelled language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import received, sent_to_tasks, written

DIMENSION = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1000  # rows of the fitting sample for each language at most, of which a fifth calibrates
SAMPLE_ROWS = 20_000  # and of all languages together, as far as each keeps LEAST_ROWS
LEAST_ROWS = 20
MODEL_CELLS = 1 << 24  # buckets times languages: more languages share fewer buckets, none is left out
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
BROADCAST_LANGUAGES = 100_000  # rows of a name and a count up to which they travel to the tasks; beyond, a join
UNKNOWN = "und"


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts) == part


def buckets_for(languages: int) -> int:
    """The size of the n-gram table: DIMENSION, halved until the model of all languages keeps within MODEL_CELLS."""
    size = DIMENSION
    while size > 256 and size * languages > MODEL_CELLS:
        size //= 2
    return size


def gram_counts(text: str, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the text's n-grams, ascending, and how often each occurs. Space runs count as one space."""
    folded = " " + " ".join(text.lower().split()) + " "
    code = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(33 - dimension.bit_length())
    places = []
    acc = np.zeros(len(code), np.uint32)
    for order in ORDERS:
        n = len(code) - order + 1
        if n <= 0:
            break
        acc = acc[:n] * np.uint32(0x01000193) + code[order - 1 :]
        places.append(((acc ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> shift)
    total = np.bincount(np.concatenate(places), minlength=dimension)
    at = np.flatnonzero(total)
    return at, total[at]


def _weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


def _usable(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def frequencies(texts: DataFrame, dimension: int = DIMENSION) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and the number of texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimension, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if _usable(text):
                    total[gram_counts(text, dimension)[0]] += 1
                    n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(total[some], n), pa.int64())})

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency, n = np.zeros(dimension, np.int64), 0
    for bucket, total in rows:  # dimension + 1 rows at most
        if bucket < 0:
            n = total
        else:
            frequency[bucket] = total
    return frequency, n


def fitting_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` different texts of each language, by the order of a hash of the text; fewer if all languages
    together would exceed SAMPLE_ROWS, but LEAST_ROWS at least.

    A threshold on the hash, from the language's number of different texts, keeps what is ranked small before any
    text moves; copies do not lower it.
    """
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 50)) / F.lit(float(1 << 50))
    placed = labelled.select("text", "lang", place.alias("place"))
    counts = written(placed.groupBy("lang", "place").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("different")))
    languages = counts.count()
    quota = min(per_language, max(LEAST_ROWS, SAMPLE_ROWS // max(1, languages)))
    near = placed.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(F.col("place") * F.col("different") <= 3.0 * quota)
    ranked = near.groupBy("lang", "place", "text").agg(F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))
    return ranked.where(F.col("rank") <= quota).select("text", "lang", "rank")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS, seed: int = 5, dimension: int = DIMENSION) -> np.ndarray:
    """Weights (a row for each bucket and the intercept, classes) after FTRL-proximal with elastic-net penalties."""
    z = np.zeros((dimension + 1, n_classes))
    n = np.zeros((dimension + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dimension + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(1 / 20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.heat = langs, idf, weights, heat

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        dimension = len(self.idf)
        at, n = gram_counts(text, dimension)
        return np.append(at, dimension), np.append(_weighted(at, n, self.idf), 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not _usable(text) or not self.langs:
            return UNKNOWN, 0.0
        at, x = self.features(text)
        s = (x @ self.weights[at]) / self.heat
        p = np.exp(s - s.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows ``text, lang``; rows of a null language or without a letter are left out."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    dimension = buckets_for(usable.select("lang").distinct().count())
    frequency, total = frequencies(usable, dimension)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [gram_counts(t, dimension) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "rank": batch["rank"], "at": [a.astype(np.int32) for a, _ in out], "n": [n.astype(np.int32) for _, n in out]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        langs = sorted(pdf["lang"].unique())
        number = {x: k for k, x in enumerate(langs)}
        pdf = pdf.sort_values(["lang", "rank"], kind="stable")
        rows = [
            (np.append(np.asarray(a), dimension), np.append(_weighted(np.asarray(a), np.asarray(n), idf), 1.0), number[x])
            for a, n, x in zip(pdf["at"], pdf["n"], pdf["lang"], strict=True)
        ]
        back = (pdf["rank"] % 5 == 0).to_numpy()
        learn = [r for r, b in zip(rows, back, strict=True) if not b] or rows
        weights = ftrl(learn, len(langs), dimension=dimension)
        kept = [r for r, b in zip(rows, back, strict=True) if b]
        heat = temperature(np.array([x @ weights[a] for a, x, _ in kept]).reshape(len(kept), len(langs)), np.array([y for _, _, y in kept], int))
        at, k = np.nonzero(weights)
        return pd.DataFrame({"lang": [*langs, *[langs[i] for i in k]], "at": [*[-1] * len(langs), *at], "w": [*[heat] * len(langs), *weights[at, k]]})

    sample = fitting_sample(usable.select("text", F.col("lang").cast("string").alias("lang")), per_language)
    wide = sample.mapInPandas(featurise, "lang string, rank int, at array<int>, n array<int>")
    fitted = wide.withColumn("model", F.lit(1)).groupBy("model").applyInPandas(train, "lang string, at int, w double").collect()  # a bounded sample's model
    langs = sorted({r.lang for r in fitted})
    weights, heat = np.zeros((dimension + 1, len(langs))), 1.0
    number_of = {x: k for k, x in enumerate(langs)}
    for lang, at, w in fitted:
        if at < 0:
            heat = w
        else:
            weights[at, number_of[lang]] = w
    return Model(langs, idf, weights, heat)


def identify(docs: DataFrame, model: Model, kept: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, or its ``kept`` columns (``text`` among them) in place of the id.

    The prediction comes from the whole text alone. A null text, or one without a letter, is ``und`` with score 0;
    so is every text if no labelled text could be learned from. Repeated rows get equal results; an empty table gives no
    rows. Of other columns only the ``kept`` ones are looked at, whatever their names.
    """
    shared = sent_to_tasks(docs.sparkSession, model)
    names = ["doc_id"] if kept is None else kept

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        for whole in batches:
            for batch in tb.pieces(whole):
                out = [known.predict(t) for t in batch.column("text").to_pylist()]
                told = {"lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64())}
                yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in names} | told)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[x for x in names if x not in ("doc_id", "text")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields)
    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: those whose id's checksum modulo 4 is not 2, with a language."""
    return docs.where(~held_out("doc_id", 4, 2)).where("lang IS NOT NULL").select("text", "lang")
