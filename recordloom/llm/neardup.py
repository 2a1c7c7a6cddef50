"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

Each document is a weighted set: its shingles of five words, each weighing its count times a smoothed
inverse document frequency. Improved consistent weighted sampling (Ioffe 2010) draws 64 samples whose
agreement estimates the weighted Jaccard similarity; bands of four give candidates; whole texts verify them.

Scale. Texts alike word by word are joined first, so a bucket holds different texts only. A bucket is never
expanded into all its pairs: its members are compared with its most central member; what this leaves
unconnected is compared with the whole bucket, blocks of both sides of bounded size, and only pairs whose samples
agree are verified. Buckets and hubs with many members are dealt to chunks before they are joined. Nothing of the
documents passes the driver but the fixed table of frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import connected_components, dealt, hot_keys, join_dealt, materialize

WIDTH = 5  # words in a shingle
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
BUCKETS = 1 << 16  # of the hashed document-frequency table: a fixed size, whatever the corpus
PRIOR = 1.0  # corpora added to every document frequency: weights go from 1 to 1.7, so copies of a text that is itself frequent stay copies
POOL = 1 << 16  # entries of the shared table of random draws
LEVELS = 64  # steps of the logarithm of a weight that sampling tells apart
BLOCK = 1000  # members of a bucket compared with as many unconnected ones in one task
BLOCK_WORDS = 2_000_000  # and their words
HUB_CHUNK = 64  # texts verified against one copy of their hub's text
BROADCAST_IDS = 1_000_000  # ids of involved documents up to which they travel to the tasks (8 MB)
SLACK = 0.22  # below SIMILARITY, at which samples still call for verification: less than 1e-4 of the pairs at SIMILARITY fall below
SEED = 20240229


def _shingle_runs(batch: pa.RecordBatch, width: int, table: np.ndarray):
    data, at = tb.utf8(batch.column("text"))
    folded, starts, ends, doc = tb.word_spans(data, at, table)
    hashes = tb.word_hashes(folded, starts, ends)
    found, whose = tb.shingles(hashes, doc, len(batch), width)
    return hashes, tb.by_text(doc, len(batch)), found, tb.by_text(whose, len(batch))


def document_frequencies(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Documents per hash bucket of shingles, over all documents, and the number of documents with a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.spaced_words()
        total, n = np.zeros(BUCKETS, np.int64), 0
        for whole in batches:
            for batch in tb.pieces(whole):
                _, _, found, runs = _shingle_runs(batch, width, table)
                whose = np.repeat(np.arange(len(batch)), np.diff(runs)).astype(np.uint64)
                once = np.unique((whose << np.uint64(16)) | (found & np.uint64(BUCKETS - 1)))
                total += np.bincount((once & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                n += int((np.diff(runs) > 0).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(total[some], n), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, total in rows:  # BUCKETS + 1 rows at most
        if bucket < 0:
            n = total
        else:
            frequency[bucket] = total
    return frequency, n


def weights_of(frequency: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency of every bucket, from 1 (in all documents) to 1 + ln(1 + 1/PRIOR)."""
    return 1.0 + np.log((1 + PRIOR) * max(n, 1) / (np.minimum(frequency, max(n, 1)) + PRIOR * max(n, 1)))


class Sampler:
    """Consistent weighted samples of weighted sets of 64-bit keys.

    The draws r, c (gamma) and beta (uniform) of a key and a sample come from a pool that the key and the
    sample address by a hash. Logarithms of weights are rounded to LEVELS steps, so that ln a is a table.
    """

    def __init__(self, idf: np.ndarray, samples: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.idf = idf
        self.r, self.c, self.beta = rng.gamma(2, 1, POOL), np.log(rng.gamma(2, 1, POOL)), rng.random(POOL)
        self.factors = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.adds = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.step = np.log(2) / 8
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.tables:
            t = np.floor(level * self.step / self.r + self.beta)
            self.tables[level] = (self.c - self.r * (t + 1 - self.beta)).astype(np.float32), t.astype(np.int64)
        return self.tables[level]

    def __call__(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One 64-bit sample for each draw; equal samples of two sets agree in key and in level t."""
        level = np.rint(np.log(counts * self.idf[(keys & np.uint64(BUCKETS - 1)).astype(np.int64)]) / self.step).astype(np.int64)
        best = np.full(len(self.factors), np.inf, np.float32)
        out = np.zeros(len(self.factors), np.uint64)
        for lv in np.unique(level):
            ln_a, t = self.table(int(lv))
            own = keys[level == lv]
            for part in range(0, len(own), 4096):
                some = own[part : part + 4096]
                at = ((some[None, :] * self.factors[:, None] + self.adds[:, None]) >> np.uint64(48)).astype(np.int32)
                a = ln_a[at]
                k = a.argmin(axis=1)
                row = np.arange(len(k))
                low, key = a[row, k], some[k]
                better = (low < best) | ((low == best) & (key < out))
                best = np.where(better, low, best)
                out = np.where(better, tb.mix(key ^ (t[at[row, k]].astype(np.uint64) << np.uint64(40))), out)
        return out


def signatures(docs: DataFrame, frequency: np.ndarray, n: int, width: int = WIDTH) -> DataFrame:
    """Per row with a text: ``doc_id, h1, h2`` (of the word sequence), ``bands``, ``samples`` (one byte of each) and ``words``."""
    idf = weights_of(frequency, n)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler = tb.spaced_words(), Sampler(idf)
        places = tb.mix(np.arange(1, 1 << 12, dtype=np.uint64)) | np.uint64(1)
        for whole in batches:
            for batch in tb.pieces(whole):
                hashes, words, found, runs = _shingle_runs(batch, width, table)
                h1, h2, bands, samples = [], [], [], []
                sizes = pa.array(np.diff(words).astype(np.int64))
                for d in range(len(batch)):
                    own = hashes[words[d] : words[d + 1]]
                    if len(own) >= len(places):
                        places = tb.mix(np.arange(1, 2 * len(own) + 2, dtype=np.uint64)) | np.uint64(1)
                    h1.append(int((tb.mix(own) * places[: len(own)]).sum(dtype=np.uint64)))
                    h2.append(int((tb.mix(own ^ np.uint64(0x5BD1E995)) * places[1 : len(own) + 1]).sum(dtype=np.uint64)) ^ len(own))
                    if not len(own):
                        bands.append([])
                        samples.append(b"")
                        continue
                    keys, counts = np.unique(found[runs[d] : runs[d + 1]], return_counts=True)
                    drawn = sampler(keys, counts)
                    groups = drawn.reshape(BANDS, ROWS)
                    acc = np.arange(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        acc = tb.mix(acc + groups[:, k])
                    bands.append(acc.view(np.int64))
                    samples.append((drawn >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "h1": pa.array(np.array(h1, np.uint64).view(np.int64)),
                        "h2": pa.array(np.array(h2, np.uint64).view(np.int64)),
                        "bands": pa.array(bands, pa.list_(pa.int64())),
                        "samples": pa.array(samples, pa.binary()),
                        "words": sizes,
                    }
                )

    schema = "doc_id long, h1 long, h2 long, bands array<long>, samples binary, words long"
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted keys, weights)."""
    (ka, wa), (kb, wb) = a, b
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    low = float(np.minimum(wa[same], wb[at[same]]).sum())
    union = float(wa.sum() + wb.sum()) - low
    return low / union if union else 1.0


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids`` (distinct, column doc_id).

    Few ids travel to the tasks that read the texts, so that other texts are not shuffled; many are joined.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, frequency: np.ndarray, n: int, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Of ``pairs`` (hub, member), those of weighted Jaccard similarity at least ``similarity``: ``a, b, similarity``.

    A hub's text travels once for each chunk of its members, and each chunk is a bounded group.
    """
    idf = weights_of(frequency, n)
    hot = hot_keys(pairs.groupBy("hub").agg(F.count("*").alias("size")), "hub", HUB_CHUNK)
    chunked = dealt(pairs, "hub", "member", hot).select("hub", F.col("_chunk").alias("chunk"), "member")
    wanted = chunked.select(F.col("member").alias("doc_id"), "hub", "chunk", F.lit(1).alias("role")).unionByName(
        chunked.select(F.col("hub").alias("doc_id"), "hub", "chunk", F.lit(0).alias("role")).distinct()
    )
    wanted = materialize(wanted)
    placed = texts_of(docs, wanted.select("doc_id").distinct()).join(wanted, "doc_id").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group, center = tb.spaced_words(), None, None
        for whole in batches:
            for batch in tb.pieces(whole):
                _, _, found, runs = _shingle_runs(batch, width, table)
                ids, hubs = batch.column("doc_id").to_pylist(), batch.column("hub").to_pylist()
                chunks, roles = batch.column("chunk").to_pylist(), batch.column("role").to_pylist()
                out = []
                for d in range(len(batch)):
                    keys, counts = np.unique(found[runs[d] : runs[d + 1]], return_counts=True)
                    bag = keys, counts * idf[(keys & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    if roles[d] == 0:
                        group, center = (hubs[d], chunks[d]), bag
                    elif group == (hubs[d], chunks[d]):
                        s = weighted_jaccard(center, bag)
                        if s >= similarity:
                            out.append((hubs[d], ids[d], s))
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array([x[0] for x in out], pa.int64()),
                        "b": pa.array([x[1] for x in out], pa.int64()),
                        "similarity": pa.array([x[2] for x in out], pa.float64()),
                    }
                )

    return placed.select("hub", "chunk", "role", "doc_id", "text").mapInArrow(compare, "a long, b long, similarity double")


def _links_of_unconnected(members: DataFrame, samples: DataFrame, docs: DataFrame, frequency: np.ndarray, n: int, width: int, similarity: float, hot: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of components that a link joins inside one bucket, for the buckets that still hold several.

    Members outside a bucket's main component (the one of its center) meet the whole bucket, blocks of both sides, with
    their texts. Pairs whose samples agree in a share of at least similarity - SLACK are verified there; a task leaves
    out pairs whose components it has linked already, and only links leave it.
    """
    idf = weights_of(frequency, n)
    stats = members.groupBy("band").agg(
        F.count("*").alias("size"), F.sum("words").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("central", "rep")).alias("main")
    ).where("low <> high")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_WORDS))
    open_ = materialize(join_dealt(members, stats.select("band", "main", blocks.alias("blocks")), "band", "rep", hot).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    odd_blocks = open_.where("component <> main").groupBy("band", F.col("own").alias("i")).agg(F.lit(1))
    whole = open_.withColumn("i", each).join(odd_blocks.select("band", "i"), ["band", "i"], "left_semi").select("band", (F.col("i") * F.col("blocks") + F.col("own")).alias("block"), F.lit(1).alias("role"), "rep", "component")
    odd = open_.where("component <> main").withColumn("j", each).select("band", (F.col("own") * F.col("blocks") + F.col("j")).alias("block"), F.lit(0).alias("role"), "rep", "component")
    ids = open_.select(F.col("rep").alias("doc_id")).distinct()
    told = texts_of(docs, ids).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"]).join(samples, "rep")
    met = whole.unionByName(odd).join(told, "rep").repartition("band", "block").sortWithinPartitions("band", "block", "role", "rep")
    least = similarity - SLACK

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group = tb.spaced_words(), None
        odd_rows: list[tuple] = []
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        packed = None
        for large in batches:
            for batch in tb.pieces(large):
                _, _, found, runs = _shingle_runs(batch, width, table)
                bands, blocks, roles, reps, comps, drawn = (batch.column(x).to_pylist() for x in ("band", "block", "role", "rep", "component", "samples"))
                out = []
                for i in range(len(batch)):
                    if group != (bands[i], blocks[i]):
                        group, packed = (bands[i], blocks[i]), None
                        odd_rows, joined = [], {}
                    own = np.frombuffer(drawn[i], np.uint8)
                    bag = None
                    if roles[i] == 0 or odd_rows:
                        keys, counts = np.unique(found[runs[i] : runs[i + 1]], return_counts=True)
                        bag = keys, counts * idf[(keys & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    if roles[i] == 0:
                        odd_rows.append((reps[i], comps[i], own, bag))
                        packed = None
                    elif odd_rows:
                        if packed is None:
                            packed = np.stack([x[2] for x in odd_rows])
                        share = (packed == own[None, :]).mean(axis=1)
                        for k in np.flatnonzero(share >= least):
                            _, comp, _, its_bag = odd_rows[k]
                            if root(comp) != root(comps[i]) and weighted_jaccard(its_bag, bag) >= similarity:
                                joined[root(comp)] = root(comps[i])
                                out.append((comp, comps[i]))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return met.select("band", "block", "role", "rep", "component", "samples", "text").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, keep``.

    ``class_id`` is the smallest doc_id of the documents connected by links of weighted Jaccard similarity of
    at least ``similarity``; ``keep`` marks the document that stays for its class. Words are separated by white
    space, A-Z count as a-z. A null text is a class of its own; texts without a word are copies of one another;
    a text of fewer than ``width`` words is one shingle. Repeated rows get the same class. A null
    doc_id has no links but equal texts. An empty table gives no rows. Other columns of ``docs`` play no part.
    """
    frequency, n = document_frequencies(docs, width)
    signed = materialize(signatures(docs, frequency, n, width))
    texts = materialize(
        signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.first("words").alias("words"))
    )
    banded = texts.where(F.size("bands") > 0).select("rep", "words", F.explode("bands").alias("band"))
    sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    hot = hot_keys(sizes, "band")
    shared = materialize(join_dealt(banded, sizes, "band", "rep", hot))
    central = shared.groupBy("rep").agg(F.sum("size").alias("central"))
    members = materialize(shared.select("band", "rep", "words").join(central, "rep"))
    centers = members.groupBy("band").agg(F.max_by("rep", F.struct("central", "rep")).alias("hub"))
    star = join_dealt(members, centers, "band", "rep", hot).where("rep <> hub")
    star = star.groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    links = materialize(verify(star.select("hub", (F.col("a") + F.col("b") - F.col("hub")).alias("member")), docs, frequency, n, width, similarity).select("a", "b"))
    joined = connected_components(links)
    labelled = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = materialize(_links_of_unconnected(labelled, texts.select("rep", "samples"), docs, frequency, n, width, similarity, hot))
    if not more.isEmpty():
        # components that these links join get the smallest node of all; a component is named by its own smallest
        again = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        ones = again.select(F.col("component").alias("node"), "component")
        joined = joined.unionByName(ones).distinct().join(again, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    classes = texts.select("h1", "h2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("h1", "h2", F.coalesce("component", "rep").alias("class_id"))
    found = signed.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id")
    alone = docs.where("text IS NULL").select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("class_id", F.col("doc_id"))
    return found.unionByName(alone).withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))
