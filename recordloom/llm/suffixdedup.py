"""Repeated byte strings of 100 bytes across all texts, by two-stage suffix sorting.

Strings that may be equal are brought together first. Every string of 100 bytes has an anchor, its 40-byte gram of the
least hash, and equal strings have equal anchors at the same place. Successive strings of one anchor form a context, the
bytes that they cover together; contexts do not share strings. An anchor that occurs once is dropped; of equal contexts
all but the first repeat as a whole. The different contexts of an anchor are suffix-sorted together: only suffixes
smaller than their successors are sorted directly, the rest are induced by bucket scans, and adjacent common prefixes of
100 bytes or more show the strings that occur elsewhere. Of these, all but the first in the order of (doc_id, start)
are marked.

Scale. About one row for 28 bytes leaves a task as five numbers, and equal contexts of one batch leave as one
candidate; texts are shuffled only to cut contexts of different bytes and to take out what is marked, and only
those concerned. Suffix arrays are built for chunks of bounded size; the contexts of an anchor with more than GROUP
of them are first cut into cells, by the place of the anchor in their strings (WIDTHS), until they form smaller groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import BROADCAST_IDS, hot_keys, join_dealt, of_ids, written

LENGTH = 100  # bytes of a string that counts
GRAM = 40  # bytes of an anchor
WINDOW = LENGTH - GRAM + 1  # grams of a string
PIECE = 1 << 18  # bytes looked into at once; working arrays take about a hundred times as much
CHUNK = 2000  # contexts suffix-sorted together
GROUP = 1000  # contexts of one anchor up to which they are sorted in one chunk
WIDTHS = (16, 4, 1)  # places of the anchor in the strings of one cell, round by round
_ODD = 0x9E3779B97F4A7C15


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base modulo 2^64, and their inverses, for texts of up to ``n`` bytes."""
    tables = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        table = np.full(n + 1, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


def prefix_hashes(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes modulo 2^64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end, wherever they stand."""
    return tb.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least, and of equal ones the first, of every ``width`` successive values."""
    low, at, span = values, np.arange(len(values), dtype=np.int32), 1

    def combine(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift : shift + n] < low[:n]
        place = at[:n].copy()
        np.copyto(place, at[shift : shift + n], where=right)
        return np.minimum(low[:n], low[shift : shift + n]), place

    while 2 * span <= width:
        low, at = combine(span, len(low) - span)
        span *= 2
    if span < width:
        low, at = combine(width - span, len(values) - width + 1)
    return at


def contexts_of(data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts (their bytes, and where each begins), in bounded blocks: text, anchor, first and last string, gram and context hash.

    ``tables`` are power tables for PIECE + LENGTH bytes.
    """
    powers, inverse = tables
    whose = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    for begin in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        block = data[begin : begin + PIECE + LENGTH - 1]
        if len(block) < LENGTH:
            return
        sums = prefix_hashes(block, powers)
        grams = tb.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(block) - GRAM + 1] + np.uint64(GRAM))
        best = first_least(grams, WINDOW)
        doc = whose[begin : begin + len(best)]
        start = np.flatnonzero(doc == whose[begin + LENGTH - 1 : begin + LENGTH - 1 + len(best)])
        doc, best = doc[start], best[start]
        if not len(start):
            continue
        head = np.flatnonzero(heads(best, doc))
        low, high, anchor, doc = start[head], start[np.append(head[1:], len(start)) - 1], best[head].astype(np.int64), doc[head]
        # strings at other places of their anchor's context are other contexts
        context = span_hashes(sums, inverse, low, high + LENGTH) ^ tb.mix((anchor - low).astype(np.uint64) + np.uint64(7))
        offset = begin - at[doc]
        yield doc, anchor + offset, low + offset, high + offset, grams[anchor], context


def two_stage_suffix_array(text: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Suffixes of a byte string that ends in 0, in the order of their first ``depth`` bytes at least.

    ``words`` holds the eight bytes from each place on, up to ``depth`` places beyond the end (``words_at``).
    A suffix smaller than its successor is sorted directly, eight bytes a round. Scans of the buckets of first
    bytes, in ascending order, then induce the others: a suffix of the larger kind follows, in its bucket, in
    the order of its successor.
    """
    n = len(text)
    code = text.astype(np.int64)
    step = np.sign(np.diff(code))
    # the kind of a run of equal bytes is that of the first change after it; the last suffix is of the larger kind
    change = np.append(np.flatnonzero(step), n - 1)
    ahead = np.searchsorted(change, np.arange(n))
    kind = np.append(step, -1)[change]
    smaller = kind[np.minimum(ahead, len(change) - 1)] > 0
    smaller[text == 0] = True
    direct = np.flatnonzero(smaller & (text != 0))
    key = words[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.cumsum(heads(key))
    tied = np.arange(len(direct))
    for shift in range(8, depth, 8):
        new = heads(group)
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = tied[~alone]  # places of the order that are still to be settled, whole groups of them
        group = group[~alone]
        if not len(tied):
            break
        key = words[direct[tied] + shift]
        at = np.lexsort((key, group))
        direct[tied] = direct[tied[at]]
        key = key[at]
        # a group splits where the next word differs
        group = np.cumsum(heads(group, key))
    zeros = np.flatnonzero(text == 0)
    by_byte = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def hand_on(batch: np.ndarray, byte: int) -> np.ndarray:
        """Give the larger-kind predecessors of a batch to their buckets; return those of the same bucket."""
        before = batch[batch > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        same = before[first == byte]
        rest, first = before[first != byte], first[first != byte]
        at = np.argsort(first, kind="stable")
        rest, first = rest[at], first[at]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part, head in zip(np.split(rest, cuts), first[np.concatenate([[0], cuts])] if len(first) else [], strict=False):
            induced[head].append(part)
        return same

    out.append(zeros)
    hand_on(zeros, 0)
    for byte in range(1, 256):
        batches = induced[byte]
        while batches:
            batch = np.concatenate(batches)
            out.append(batch)
            more = hand_on(batch, byte)
            batches = [more] if len(more) else []
        own = direct[by_byte[byte] : by_byte[byte + 1]]
        out.append(own)
        hand_on(own, byte)
    return np.concatenate(out)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Whether each element begins a run of equal keys."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places on, as big-endian integers."""
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return out


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to ``most``."""
    out = np.full(len(a), most, np.int64)
    alive = np.arange(len(a))
    for shift in range(0, most, 8):
        differ = words[a[alive] + shift] ^ words[b[alive] + shift]
        ended = differ != 0
        if ended.any():
            x = differ[ended]
            bytes_same = np.zeros(len(x), np.int64)
            for k in range(1, 8):
                bytes_same += x < (np.uint64(1) << np.uint64(64 - 8 * k))
            out[alive[ended]] = np.minimum(most, shift + bytes_same)
        alive = alive[~ended]
        if not len(alive):
            break
    return out


def repeats(contexts: list[bytes], ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(id, key, start, end) of the strings of LENGTH bytes in ``contexts`` that also start earlier.

    Earlier is in a text of a smaller id, or in the same text (id and key) at an earlier place. ``starts`` is the place
    of each context's first byte in its text. Bytes are moved up by one so that 0 can end a context; no UTF-8
    text has the byte 255.
    """
    size = np.array([len(x) for x in contexts], np.int64)
    if len(size) < 2:
        return []
    first = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8) + np.uint8(1)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    left = first[owner] + size[owner] - np.arange(len(text))  # bytes from here to the context's end
    words = words_at(np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)]), len(text) + LENGTH + 8)
    order = two_stage_suffix_array(text, LENGTH + 4, words)
    order = order[left[order] >= LENGTH]
    same = common_prefixes(words, order[:-1], order[1:], LENGTH) >= LENGTH
    # suffixes that share LENGTH bytes with none beside them occur once
    found = np.append(same, False) | np.append(False, same)
    cls = np.concatenate([[0], np.cumsum(~same)])[found]
    order = order[found]
    where = starts[owner[order]] + order - first[owner[order]]
    whose, key = ids[owner[order]], keys[owner[order]]
    by = np.lexsort((where, key, whose, cls))
    cls, whose, key, where = cls[by], whose[by], key[by], where[by]
    least = np.maximum.accumulate(np.where(heads(cls), np.arange(len(by)), 0))
    own = np.maximum.accumulate(np.where(heads(cls, whose, key), np.arange(len(by)), 0))
    hit = np.flatnonzero((whose != whose[least]) | (where != where[own]))
    if not len(hit):
        return []
    hit = hit[np.lexsort((where[hit], key[hit], whose[hit]))]
    d, k, p = whose[hit], key[hit], where[hit]
    at = np.flatnonzero(heads(d, k, p - np.arange(len(p))))
    last = np.append(at[1:], len(hit)) - 1
    return list(zip(d[at].tolist(), k[at].tolist(), p[at].tolist(), (p[last] + LENGTH).tolist(), strict=True))


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    names = ("id", "key", "start", "end")
    return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(names)})


def candidates(rows: DataFrame) -> DataFrame:
    """``gram, context, id, key, place, again`` of every context of the texts; place packs anchor, first and last string.

    Of equal contexts of one batch those of the least id, and of each text the first, are candidates; the others occur
    again for sure, whatever other tasks hold. They get a key of their own in place of the gram, so that a frequent passage is no hot key.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = power_tables(PIECE + LENGTH)
        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                data, at = tb.utf8(batch.column("text"))
                ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
                for doc, anchor, low, high, gram, context in contexts_of(data, at, tables):
                    place, whose, key = (anchor << 12) | ((anchor - low) << 6) | (high - low), ids[doc], keys[doc]
                    order = np.lexsort((place, key, whose, context, gram))
                    gram, context, whose, key, place = (x[order] for x in (gram, context, whose, key, place))
                    least = np.maximum.accumulate(np.where(heads(gram, context), np.arange(len(gram)), 0))
                    own = np.maximum.accumulate(np.where(heads(gram, context, whose, key), np.arange(len(gram)), 0))
                    again = (whose != whose[least]) | (place != place[own])
                    gram[again] = tb.mix(gram[again] + tb.mix(whose[again].view(np.uint64)) + place[again].astype(np.uint64))
                    columns = {"gram": gram.view(np.int64), "context": context.view(np.int64), "id": whose, "key": key, "place": place, "again": again}
                    yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})

    return rows.select("id", "key", "text").mapInArrow(find, "gram long, context long, id long, key long, place long, again boolean")


def lead() -> Column:
    """The bytes of a context before its anchor."""
    return F.shiftright("place", 6).bitwiseAND(F.lit(63))


def first_string() -> Column:
    return F.shiftright("place", 12) - lead()


def behind() -> Column:
    """The byte behind a context."""
    return first_string() + F.col("place").bitwiseAND(F.lit(63)) + LENGTH


LOWEST = -(1 << 63)  # stands for a null id, before all others


def placed_rows(docs: DataFrame) -> DataFrame:
    """``id, key, text`` of every row; rows of one id and one text are one place, told by the key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """``id, key, spans``: of the texts (``placed_rows``) with something to remove, spans (start, end) in bytes by start;
    they may overlap, and may end behind the text."""
    long = rows.where(F.octet_length("text") >= LENGTH)
    # a copy of a whole text in a row of a larger id loses everything, so only the first of the copies is looked into
    digests = written(long.select("id", "key", F.md5("text").alias("m")))
    firsts = digests.groupBy("key", "m").agg(F.min("id").alias("id"))
    copies = written(digests.select("id", "key").distinct().join(firsts.select("id", "key"), ["id", "key"], "left_anti"))
    anchors = candidates(without(long, copies))
    by_gram, by_context = Window.partitionBy("gram"), Window.partitionBy("gram", "context").orderBy("id", "key", "place")
    seen = anchors.repartition("gram").select(
        "*",
        F.first("id").over(by_context).alias("least"),
        F.min("place").over(Window.partitionBy("gram", "context", "id", "key")).alias("own"),
        (F.min("context").over(by_gram) < F.max("context").over(by_gram)).alias("open"),
        F.count("*").over(by_gram).alias("size"),
    )
    # equal contexts: those of the least id stay, one in each of its texts
    later = F.col("again") | (F.col("id") != F.col("least")) | (F.col("place") != F.col("own"))
    seen = seen.withColumn("again", later).where("again OR open")
    seen = written(seen.select("id", "key", "place", "again", F.when(~F.col("again"), F.col("gram")).alias("gram"), (~F.col("again") & (F.col("size") > group)).alias("large")))
    whole_contexts = seen.where("again").select("id", "key", first_string().alias("start"), behind().alias("end"))
    unsettled = seen.where("NOT again")
    spots = unsettled.groupBy("id", "key").agg(F.collect_list(F.struct("gram", "large", lead().alias("lead"), first_string().alias("start"), behind().alias("end"))).alias("spots"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                data, at = tb.utf8(batch.column("text"))
                raw, spots_ = data.tobytes(), batch.column("spots")
                each, fields = pc.list_value_length(spots_).to_numpy(), spots_.flatten()
                gram, large, before, low, high = (fields.field(x) for x in ("gram", "large", "lead", "start", "end"))
                doc = np.repeat(np.arange(len(batch)), each)
                start, end = (at[doc] + x.to_numpy() for x in (low, high))
                for k in range(0, len(doc), 4096):
                    some = slice(k, k + 4096)
                    context = pa.array([raw[i:j] for i, j in zip(start[some].tolist(), end[some].tolist(), strict=True)], pa.binary())
                    ids, keys = (batch.column(x).take(pa.array(doc[some])) for x in ("id", "key"))
                    yield pa.RecordBatch.from_pydict({"gram": gram[some], "large": large[some], "id": ids, "key": keys, "start": low[some], "lead": before[some], "context": context})

    placed = of_ids(long, unsettled.select("id").distinct(), "left_semi", "id").join(spots, ["id", "key"]).dropDuplicates(["id", "key"])
    contexts = placed.select("id", "key", "text", "spots").mapInArrow(cut, "gram long, large boolean, id long, key long, start long, lead long, context binary")
    any_large = not unsettled.where("large").isEmpty()
    contexts = written(contexts) if any_large else contexts

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int]] = []
        last = None

        def settle() -> pa.RecordBatch:
            found = repeats([x[0] for x in held], *(np.array([x[k] for x in held], np.int64) for k in (1, 2, 3)))
            held.clear()
            return _spans(found)

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("gram", "context", "id", "key", "start"))
            for gram, context, i, key, start in zip(*columns, strict=True):
                if gram != last and len(held) >= CHUNK:
                    yield settle()
                last = gram
                held.append((context, i, key, start))
        if held:
            yield settle()

    columns = ("gram", "context", "id", "key", "start")
    few = contexts.where("NOT large").select(*columns)
    if any_large:
        cells, whole_cells = _cells(contexts.where("large").drop("large"), group)
        few, whole_contexts = few.unionByName(cells.select(*columns)), whole_contexts.unionByName(whole_cells)
    marked = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "id long, key long, start long, end long")
    marked = marked.unionByName(whole_contexts)
    marked = marked.unionByName(copies.select("id", "key", F.lit(0).cast("long").alias("start"), F.lit((1 << 62)).alias("end")))
    return marked.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and key are not among the ``gone``."""
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, ["id", "key"], "left_anti")


def deduplicate(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, kept, removed, n_bytes`` for every row of ``docs``: the remaining bytes, and the maximal removed spans
    (start, end) in bytes of the text.

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a text of smaller
    doc_id, or earlier in its own. Strings are judged on the input. A null text is empty; a null doc_id comes
    before all others. Rows of one doc_id are no earlier than one another, and equal ones are one place, so they keep
    each other. An empty table gives no rows; texts shorter than LENGTH keep all their bytes. Columns beside
    ``doc_id, text`` play no part.
    """
    rows = placed_rows(docs)
    spans = written(repeated_spans(rows, group))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, size=PIECE):
                data, at = tb.utf8(batch.column("text"))
                spans_ = batch.column("spans")
                fields, edge = spans_.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(spans_).to_numpy())])
                start, end = (fields.field(x).to_numpy() for x in ("start", "end"))
                kept, removed = [], []
                for d in range(len(batch)):
                    raw, own = data[at[d] : at[d + 1]], slice(edge[d], edge[d + 1])
                    # spans come by start: a new run begins where one starts behind all that ended before
                    low, high = start[own], np.minimum(np.maximum.accumulate(end[own]), len(raw))
                    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                    low, high = low[first], high[np.append(first[1:], len(low)) - 1]
                    keep, last = [], 0
                    for a, b in zip(low.tolist(), high.tolist(), strict=True):
                        keep.append(raw[last:a].tobytes())
                        last = b
                    kept.append(b"".join([*keep, raw[last:].tobytes()]))
                    removed.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                sizes = pa.array(np.diff(at).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, kinds), "n_bytes": sizes})

    schema = "id long, kept binary, removed array<struct<start:bigint,end:bigint>>, n_bytes long"
    few = of_ids(rows, spans.select("id"), "left_semi", "id")
    touched = few.join(spans, ["id", "key"]).select("id", "text", "spans").mapInArrow(cut_out, schema)
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    whole = without(rows, spans.select("id", "key")).select("id", F.encode("text", "UTF-8").alias("kept"), none.alias("removed"), F.octet_length("text").cast("long").alias("n_bytes"))
    return touched.unionByName(whole).select(F.when(F.col("id") != LOWEST, F.col("id")).alias("doc_id"), "kept", "removed", "n_bytes")


def _cells(contexts: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Of the contexts of large groups: parts that are still to be sorted, in groups of up to ``group`` by ``gram``, and
    ``id, key, start, end`` of parts that repeat as a whole.

    Equal strings have their anchor at the same place, so a cell takes the strings with the anchor at one of ``width``
    successive places. All of them hold the bytes that the first and the last such string share around the anchor: a
    context gives each cell one part, and parts that differ in these bytes share no string. What is still a large group meets
    smaller cells; in those of one place a part is one string. Aggregations that combine before the shuffle decide; of the rows,
    only those of one part within one text need to meet.
    """
    few, whole = [], []
    for width in WIDTHS:
        parts = written(_parts(contexts, width))
        least = written(parts.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("size")))
        told = join_dealt(parts, least.drop("size"), "digest", "id", hot_keys(least, "digest"))
        own = F.min("start").over(Window.partitionBy("digest", "id", "key"))
        told = written(told.withColumn("again", (F.col("id") != F.col("least")) | (F.col("start") != own)).drop("least"))
        whole.append(told.where("again").select("id", "key", "start", (F.col("start") + F.octet_length("context")).alias("end")))
        if width == 1:
            break
        firsts = told.where("NOT again").drop("again")
        sizes = firsts.groupBy("gram").agg(F.count("*").alias("size"), (F.min("digest") < F.max("digest")).alias("open"))
        sizes = written(sizes.where("open").drop("open"))
        large = sizes.where(F.col("size") > group).select("gram")
        few.append(of_ids(firsts, large, "left_anti", "gram").join(sizes.select("gram"), "gram"))
        contexts = of_ids(firsts, large, "left_semi", "gram").drop("digest")
        if contexts.isEmpty():
            break
    return reduce(DataFrame.unionByName, few), reduce(DataFrame.unionByName, whole)


def _parts(contexts: DataFrame, width: int) -> DataFrame:
    """``gram, id, key, start, lead, context, digest`` of the parts of contexts in cells of ``width`` places; gram now stands for the
    cell and the bytes that all its strings hold, digest for the part."""
    least = F.col("lead") - (F.octet_length("context") - LENGTH)  # bytes before the anchor in the last string
    cell = F.explode(F.sequence(F.floor(least / width), F.floor(F.col("lead") / width))).alias("cell")
    low, high = F.col("cell") * width, F.least((F.col("cell") + 1) * width, F.lit(WINDOW)) - 1
    found = contexts.select("*", cell, least.alias("least"))
    first, last = F.least(high, "lead"), F.greatest(low, "least")

    def cut(begin: Column, end: Column) -> Column:
        """Bytes from ``begin`` before the anchor to the end of the string with ``end`` before it."""
        return F.col("context").substr((F.col("lead") - begin + 1).cast("int"), (begin - end + LENGTH).cast("int"))

    shared = cut(low, high)
    gram = F.xxhash64("gram", "cell", shared)
    told = F.concat(F.concat_ws(" ", "gram", "lead", F.lit("")).cast("binary"), "context")
    out = found.select(gram.alias("gram"), "id", "key", (F.col("start") + F.col("lead") - first).alias("start"), first.alias("lead"), cut(first, last).alias("context"))
    return out.withColumn("digest", F.md5(told))
