"""How the sources of a language differ from it and from each other, term by term.

Counts. Texts are cut where they are read; a task counts the terms of each language and source of a chunk of text, and
counts meet by language, source and term, so neither a hot source nor a frequent word is a group of texts. What is kept
for each term is a posting list: the sources that hold it and how often.

Terms of a source. All terms of one count in a source have one probability p there, so within such a bucket the value
falls with the language's probability q: the smallest q of the bucket bounds it. Buckets are evaluated best bound first,
for all sources at once and in growing rounds, until every bucket not seen is bounded strictly below the k-th value.

Pairs of sources. A pair's value sums over all kept terms, of which most are in neither source. Buckets give the sum as if
no term were in both, postings correct it for the terms that are: no list of terms meets another.

Scale. One scan of the texts and a shuffle of (language, source, term) counts; all else works on those. The pairs are
as many as the result has rows; posting lists are no longer than a language has sources and are dealt in pieces of
LIST_BLOCK. Tables of groups and buckets travel to the tasks up to NEAR rows, by a count, and are joined beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import written

CHUNK = 6 << 20  # bytes of text whose terms are counted together, one document at least
LIST_BLOCK = 512  # of a posting list that a task pairs with the whole list
SPELLED = 1 << 16  # words that are written out at once
PAIRS = 1 << 19  # pairs that are evaluated as one array, one term at least
NEAR = 500_000  # rows of a table that travel to the tasks (about 30 MB)
GROWTH = 16
# How often a kept term is found, the scale of probabilities and the ranks of a source's terms.
LEAST_DOCUMENTS, SCALE, RANKS = 3, 1_000_000_000, 200


def letters() -> np.ndarray:
    """Byte table: every ASCII byte but letters separates, A-Z become lower case."""
    table = tb.plain_words()
    table[48:58] = 0
    return table


def near(rows: DataFrame) -> DataFrame:
    """Sent to the tasks if it has NEAR rows at most; ``rows`` should be a written table."""
    return F.broadcast(rows) if rows.limit(NEAR + 1).count() <= NEAR else rows


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: for each group and term, occurrences and documents that hold it.

    Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z as a-z; null columns count as ''. Within a chunk
    terms are told by hashes of 64 bits. Texts without a term give no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount = [], 0
        for whole in batches:
            for piece, own in tb.slices(whole, size=max(1, CHUNK // 4)):
                held.append(piece)
                amount += own
                if amount >= CHUNK:
                    yield _counts(held)
                    held, amount = [], 0
        if held:
            yield _counts(held)

    blank = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = blank.where("text <> ''").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(columns[0]) else False
    return np.flatnonzero(differs)


def _spelled(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words that begin at ``first`` as an Arrow array."""
    ends = np.append(0, np.cumsum(length, dtype=np.int64))
    letters = text[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))


def _counts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    codes = [rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
    pair = np.asarray(codes[0].indices).astype(np.int64) * len(codes[1].dictionary) + np.asarray(codes[1].indices)
    order = np.argsort(pair, kind="stable")
    rows, pair = rows.take(pa.array(order)).combine_chunks(), pair[order]
    table, folded, first, length, owner, hashes, done, size = letters(), [], [], [], [], [], 0, 0
    for batch in rows.to_batches():
        for piece, _ in tb.slices(batch):
            data, at = tb.utf8(piece.column("text"))
            bytes_, starts, ends, doc = tb.word_spans(data, at, table)
            folded.append(bytes_)
            first.append((starts + size).astype(np.int64 if size > 1 << 30 else np.int32))
            length.append((ends - starts).astype(np.int32))
            hashes.append(tb.word_hashes(bytes_, starts, ends))
            owner.append((doc + done).astype(np.int32))
            done, size = done + len(piece), size + len(bytes_)
    text, first, length, owner, term = (np.concatenate(x) for x in (folded, first, length, owner, hashes))
    del folded, hashes
    order = np.argsort(term, kind="stable")  # then by document, and so by group
    head = _heads(term[order], owner[order])
    times = np.diff(np.append(head, len(order)))
    where = order[head]
    term, group = term[where], pair[owner[where]]
    head = _heads(term, group)
    n = np.add.reduceat(times, head) if len(head) else times
    docs = np.diff(np.append(head, len(term)))
    where, group = where[head], group[head]
    words = pa.chunked_array([_spelled(text, first[w], length[w]) for w in np.array_split(where, max(1, len(where) // SPELLED))]).combine_chunks()
    langs, sources = (c.dictionary.take(pa.array(i)) for c, i in zip(codes, np.divmod(group, max(1, len(codes[1].dictionary))), strict=True))
    columns = {"lang": langs.cast(pa.string()), "source": sources.cast(pa.string()), "term": words, "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, total, sources``: the kept terms of each language, their occurrences and posting lists (source, n),
    written to the shared folder."""
    lists = counted(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("held"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return written(lists.where(F.col("held") >= least).select("lang", "term", "total", "sources"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact for any counts."""
    whole = F.greatest(total + kept, F.lit(1).cast("long"))
    small = F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), whole)
    wide = F.call_function("div", (n.cast("decimal(19,0)") + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(19,0)"))
    return F.lit(1).cast("long") + F.when(n < F.lit((1 << 62) // SCALE), small).otherwise(wide)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are below 2^31, so the square stays exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``lang, source, total, kept, lang_total, held``: every group of ``docs``, written: occurrences of kept terms in it,
    kept terms of its language and their occurrences there, and how many of them the group holds."""
    blank = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = lists.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"), F.count("*").alias("held"))
    langs = lists.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    joined = blank.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return written(joined.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total", "held")]))


def occurrences(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, term, n, in_lang, p, p0, q``: a row for each posting; p0 is the probability of what the group lacks."""
    rows = lists.select("lang", "term", F.col("total").alias("in_lang"), F.explode("sources").alias("s")).select("lang", "term", "in_lang", "s.source", "s.n")
    known = rows.join(near(groups), ["lang", "source"])
    zero = F.lit(0).cast("long")
    return known.select(
        "lang", "source", "term", "n", "in_lang",
        probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        probability(zero, F.col("total"), F.col("kept")).alias("p0"),
        probability(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"),
    )


def top_terms(rows: DataFrame, k: int = RANKS) -> DataFrame:
    """``lang, source, item, value, rank``: each group's ``k`` terms of the highest value among those more likely in the group
    than in its language; ties by the UTF-8 of the term. ``rows`` has the columns of ``occurrences``."""
    group = Window.partitionBy("lang", "source")
    buckets = rows.groupBy("lang", "source", "n").agg(F.min("q").alias("q"), F.first("p").alias("p"), F.count("*").alias("terms")).where("p > q")
    best_first = group.orderBy(F.col("bound").desc(), "n").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q"))).withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0).cast("long")))
    buckets = written(buckets.select("lang", "source", "n", "bound", "before"))
    found = None
    done, reach = 0, k
    while True:
        unseen = buckets.where(F.col("before") >= done)
        if found is not None:
            least = found.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            unseen = unseen.join(near(least), ["lang", "source"], "left").where(F.coalesce(F.col("bound") >= F.col("kth"), F.lit(True)))
            if unseen.isEmpty():
                return found.select("lang", "source", "item", "value", "rank")
        chosen = written(unseen.where(F.col("before") < reach).select("lang", "source", "n"))
        new = rows.join(near(chosen), ["lang", "source", "n"]).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        new = new if found is None else new.unionByName(found.drop("rank"))
        order = group.orderBy(F.col("value").desc(), "item")
        found = written(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done, reach = reach, reach * GROWTH


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pairs of sources that share terms: what postings add to the sum of buckets, added up for each batch."""
    for batch in batches:
        lists = batch.column("sources")
        flat = lists.flatten()
        source, p, p0 = flat.field("source").dictionary_encode(), np.asarray(flat.field("p")), np.asarray(flat.field("p0"))
        langs = batch.column("lang").dictionary_encode()
        code, lang, first = np.asarray(source.indices).astype(np.int64), np.asarray(langs.indices).astype(np.int64), np.asarray(batch.column("first"))
        at = np.asarray(lists.offsets)
        at = at - at[0]
        sizes = np.diff(at)
        left_sizes = np.minimum(sizes - first, LIST_BLOCK)
        n_sources = len(source.dictionary)
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        group = np.cumsum(left_sizes * sizes) // PAIRS
        for g in np.unique(group).tolist():
            own = np.flatnonzero(group == g)
            lefts = np.repeat(at[own] + first[own], left_sizes[own]) + _counting(left_sizes[own])
            row = np.repeat(own, left_sizes[own])
            i = np.repeat(lefts, sizes[row])
            j = np.repeat(at[row], sizes[row]) + _counting(sizes[row])
            apart = code[i] != code[j]
            i, j, row = i[apart], j[apart], np.repeat(row, sizes[row])[apart]

            def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (a - b) * (a - b) // b

            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            key = (lang[row] * n_sources + code[i]) * n_sources + code[j]
            key, where = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, value)
            keys.append(key)
            sums.append(total)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate(sums))
        rest, j = np.divmod(key, max(1, n_sources))
        lang, i = np.divmod(rest, max(1, n_sources))
        names = {"lang": langs.dictionary.take(pa.array(lang)), "source": source.dictionary.take(pa.array(i)), "item": source.dictionary.take(pa.array(j))}
        yield pa.RecordBatch.from_pydict(names | {"value": pa.array(total, pa.int64())})


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 to s - 1 for each size s, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def source_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: for each group every other source of its language; ties by the UTF-8 of the name."""
    zero = F.lit(0).cast("long")
    p0 = probability(zero, F.col("total"), F.col("kept"))
    wide = "decimal(38,0)"
    groups = groups.withColumn("p0", p0)
    others = near(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("item_held")))
    pairs = groups.join(others, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", ((F.col("kept") - F.col("held") - F.col("item_held")).cast("decimal(19,0)") * divergence(F.col("p0"), F.col("q0")).cast("decimal(19,0)")).cast(wide).alias("value"))
    buckets = rows.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count("*").alias("terms"))
    one = buckets.join(others, "lang").where("source <> item")
    terms = F.col("terms").cast("decimal(18,0)")
    alone = one.select("lang", "source", "item", (terms * divergence(F.col("p"), F.col("q0")).cast("decimal(19,0)")).cast(wide).alias("value"))
    told = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (terms * divergence(F.col("q0"), F.col("p")).cast("decimal(19,0)")).cast(wide).alias("value"))
    lists = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
    dealt = lists.select("lang", "sources", F.explode(F.sequence(F.lit(0), F.size("sources") - 1, F.lit(LIST_BLOCK))).alias("first"))
    both = dealt.mapInArrow(_shared, "lang string, source string, item string, value long").withColumn("value", F.col("value").cast(wide))
    summed = neither.unionByName(alone).unionByName(told).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, k: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of both parts, ``pair`` and ``term``.

    A null text, lang or source counts as ''. A group without terms has pairs and no terms; a language without kept terms
    gives pairs of value 0, one with a single source none. Every row is a document, repeated ones too. Other columns play
    no part; an empty table gives no rows.
    """
    lists = postings(docs, least)
    groups = group_sizes(docs, lists)
    rows = written(occurrences(lists, groups))
    terms = top_terms(rows, k).withColumn("part", F.lit("term"))
    pairs = source_pairs(rows, groups).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


#: DuckDB SQL for ``audit`` with its production parameters.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10ffff}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
