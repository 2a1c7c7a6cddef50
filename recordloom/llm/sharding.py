"""A reproducible shuffle into shards of equal counts, with DataFrame functions only.

Every row gets a global row number from its content, a Feistel permutation with cycle walking turns the number into
a place, and shard and slot follow from the place: ``place mod shards`` and ``place div shards``. So counts of shards
differ by one at most, slots have no gap, and both directions can be computed for any single row without the table.

Row numbers. A digest of each row gives it one of BUCKETS ranges. Equal rows are counted before they are shuffled,
buckets are counted, and running sums over buckets and within them give each row the rank of its digest. No range
is sampled and neither files nor partitions matter, so the same rows get the same numbers anywhere.

Scale. Texts are read once and stay where they are: digests and sizes are shuffled, in BUCKETS groups of equal
expectation; a third of all rows with one id and one text is one counted row until its numbers are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import written

SHARDS = 24
SEED = 20_24
ROUNDS = 4  # of two half rounds each
BUCKETS = 1 << 14  # ranges of digests
COPIES = 4096  # numbers that one row deals out at once
# A prime below 2^31 and the constants of the round function, so products stay below 2^62.
PRIME = 2_147_483_647
MULTIPLIER = 1_103_515_245
STEP = 1_013_904_223


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Permutation:
    """A pseudo-random permutation of 0 to n - 1: a Feistel network on the pair (x mod a, x div a), with a * b just above n.

    Places from n on, fewer than ``a``, are walked past: a number that lands on one is permuted again until it is below
    n. A walk meets each of these places once at most, which bounds it; a number needs one with a chance of about
    1 / sqrt(n). ``n`` may be 0 to 2^61.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if not 0 <= n <= 1 << 61:
            raise ValueError("a permutation has 0 to 2^61 places")
        self.n, self.seed, self.rounds = n, seed % PRIME, rounds
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        self.beyond = self.a * self.b - n

    def _key(self, k: int | Column, half: int):
        return (k * 2 + half) * STEP + self.seed

    def _mixed(self, x: Column, key: Column) -> Column:
        """A number below PRIME from one below it and a key: two squarings in a prime field, between affine steps."""
        first = bound(F.pmod(x + key, F.lit(PRIME)), lambda y: F.pmod(y * y, F.lit(PRIME)))
        second = F.pmod(first * F.lit(MULTIPLIER) + key, F.lit(PRIME))
        return bound(second, lambda y: F.pmod(y * y, F.lit(PRIME)))

    def _once(self, x: Column, back: bool = False) -> Column:
        a, b = F.lit(self.a).cast("long"), F.lit(self.b).cast("long")

        def forth_round(s: Column, k: Column) -> Column:
            return bound(
                F.pmod(s["l"] + self._mixed(s["r"], self._key(k, 0)), a),
                lambda left: F.struct(left.alias("l"), F.pmod(s["r"] + self._mixed(left, self._key(k, 1)), b).alias("r")),
            )

        def back_round(s: Column, k: Column) -> Column:
            return bound(
                F.pmod(s["r"] - self._mixed(s["l"], self._key(k, 1)), b),
                lambda right: F.struct(F.pmod(s["l"] - self._mixed(right, self._key(k, 0)), a).alias("l"), right.alias("r")),
            )

        keys = range(self.rounds - 1, -1, -1) if back else range(self.rounds)
        start = F.struct(F.pmod(x, a).alias("l"), F.call_function("div", x, a).alias("r"))
        rounds = F.array(*[F.lit(k).cast("long") for k in keys])
        return F.aggregate(rounds, start, back_round if back else forth_round, lambda s: s["r"] * a + s["l"])

    def _walked(self, x: Column, back: bool) -> Column:
        n = F.lit(self.n).cast("long")
        side = math.isqrt(self.beyond) + 1  # side * side steps are more than a walk can take

        def steps(y: Column) -> Column:
            return F.sequence(F.lit(1), F.when(y < n, 1).otherwise(side))

        def walk(first: Column) -> Column:
            def stretch(y: Column) -> Column:
                return F.aggregate(steps(y), y, lambda z, _: F.when(z < n, z).otherwise(self._once(z, back)))

            return F.aggregate(steps(first), first, lambda y, _: F.when(y < n, y).otherwise(stretch(y)))

        def on(first: Column) -> Column:
            return F.when(first < n, first).otherwise(walk(first))

        return bound(self._once(x, back), on) if self.beyond else self._once(x, back)

    def place(self, number: Column) -> Column:
        """The place of a row number (a long column of 0 to n - 1)."""
        return self._walked(number, False)

    def number(self, place: Column) -> Column:
        """The row number at a place: the inverse of ``place``."""
        return self._walked(place, True)


def numbered(rows: DataFrame, digest: str = "digest", name: str = "row_number") -> DataFrame:
    """``rows`` with a gap-free number from 0 in the order of the hexadecimal column ``digest``, then of the other columns.

    Rows equal in all columns are interchangeable and are numbered one after another. Columns must be such as can be
    grouped by. A null digest counts as '0'. An empty table stays empty.
    """
    given = rows.columns
    told = rows.withColumn(digest, F.coalesce(digest, F.lit("0")))
    first = F.conv(F.rpad(F.substring(digest, 1, 4), 4, "0"), 16, 10).cast("int")
    buckets = F.floor(first / F.lit((1 << 16) // BUCKETS)).cast("int")
    classes = written(told.groupBy(*given).agg(F.count("*").alias("_copies")).withColumn("_bucket", buckets))
    sizes = classes.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))  # BUCKETS rows at most
    before = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(digest, *[c for c in given if c != digest]).rowsBetween(Window.unboundedPreceding, -1)
    placed = classes.withColumn("_before", F.coalesce(F.sum("_copies").over(within), F.lit(0).cast("long")))
    placed = written(placed.join(F.broadcast(starts), "_bucket").withColumn("_first", F.col("_start") + F.col("_before")))
    last = F.col("_first") + F.col("_copies") - 1
    few = placed.where(F.col("_copies") <= COPIES).select(*given, F.explode(F.sequence("_first", last)).alias(name))
    parts = F.sequence("_first", last, F.lit(COPIES).cast("long"))
    many = placed.where(F.col("_copies") > COPIES).select(*given, last.alias("_last"), F.explode(parts).alias("_part"))
    many = many.repartition("_part")  # a hot row's numbers are dealt to all tasks
    return few.unionByName(many.select(*given, F.explode(F.sequence("_part", F.least("_last", F.col("_part") + (COPIES - 1)))).alias(name)))


def sharded(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, digest: str = "digest") -> DataFrame:
    """``rows`` with ``row_number, place, shard, slot``: counts of shards differ by one at most, slots count from 0 without a gap.

    The same rows, number of shards and seed give the same result however the rows are stored. Ties and odd rows as
    in ``numbered``; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    found = written(numbered(rows, digest))
    order = Permutation(found.count(), seed)
    placed = found.withColumn("place", order.place(F.col("row_number")))
    return placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def whereabouts(numbers: DataFrame, total: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``numbers`` (column ``row_number``) with ``shard, slot`` for a table of ``total`` rows, without the table."""
    placed = numbers.withColumn("place", Permutation(total, seed).place(F.col("row_number").cast("long")))
    return placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def row_numbers(slots: DataFrame, total: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``slots`` (columns ``shard, slot``) with the ``row_number`` that stands there: the inverse of ``whereabouts``."""
    place = F.col("slot").cast("long") * shards + F.col("shard")
    return slots.withColumn("row_number", Permutation(total, seed).number(place))


def _digest() -> Column:
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-")))
    return F.md5(told.cast("binary"))


def document_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest`` of every document: UTF-8 bytes of the text plus 8, its CRC-32, and an MD5 of id
    and text. A null text has no bytes (size 8, CRC 0) and a digest apart from that of an empty text; a null id is an id
    of its own. Other columns play no part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _digest().alias("digest"),
    )


def shards_of(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each row of ``docs``.

    The law is ``rows``: counts of shards differ by one at most, so a further shard moves rows and ``grown_shard`` is
    null. Rows of equal id and text are interchangeable and take a slot each; odd rows as in ``document_digests``.
    """
    found = sharded(document_digests(docs), shards, seed)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet in folders ``shard=0`` and so on, each file sorted by ``slot`` and holding a run of
    ``rows_per_file`` slots.

    Shards and slots are those of ``shards_of``; documents of equal id and text take their slots in the order of their
    other columns. Here whole rows move: to their bucket, and to their file.
    """
    placed = sharded(docs.withColumn("_digest", _digest()), shards, seed, "_digest").drop("_digest", "row_number", "place")
    dealt = placed.withColumn("_file", F.expr(f"slot div {rows_per_file}")).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    dealt.drop("_file").write.partitionBy("shard").parquet(path)


#: DuckDB SQL: CRC-32 byte by byte, digests as row numbers, and the same rounds in 64-bit integers.
def oracle_sql(shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> str:
    def mixed(x: str, key: int) -> str:
        first = f"(((({x}) + {key}) % {PRIME}) * ((({x}) + {key}) % {PRIME}) % {PRIME})"
        second = f"(({first} * {MULTIPLIER} + {key}) % {PRIME})"
        return f"({second} * {second} % {PRIME})"

    def permuted(source: str, target: str) -> str:
        steps = [f"{target}_0 AS (SELECT id, x % a AS l, x // a AS r, a, b, n FROM {source})"]
        for k in range(rounds):
            k0, k1 = (k * 2) * STEP + seed, (k * 2 + 1) * STEP + seed
            steps.append(f"{target}_{2 * k + 1} AS MATERIALIZED (SELECT id, (l + {mixed('r', k0)}) % a AS l, r, a, b, n FROM {target}_{2 * k})")
            steps.append(f"{target}_{2 * k + 2} AS MATERIALIZED (SELECT id, l, (r + {mixed('l', k1)}) % b AS r, a, b, n FROM {target}_{2 * k + 1})")
        return ",\n".join([*steps, f"{target} AS (SELECT id, r * a + l AS x, a, b, n FROM {target}_{2 * rounds})"])

    walks, names = [], []
    source = "start"
    for w in range(4):  # four walks settle every number of a table as small as the test tables
        walks.append(permuted(source, f"w{w}"))
        names.append(f"SELECT id, x FROM w{w} WHERE x < n")
        walks.append(f"s{w} AS (SELECT * FROM w{w} WHERE x >= n)")
        source = f"s{w}"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)),
crc_list AS (SELECT list(c ORDER BY i) AS t FROM crc_table),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(concat(coalesce(doc_id::VARCHAR, 'null'), coalesce('+' || text, '-'))) AS digest FROM documents),
texts AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM (SELECT DISTINCT text FROM docs)),
crc AS (
  SELECT text, len(bytes) + 8 AS size,
    xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32
  FROM texts, crc_list),
rows AS (SELECT doc_id, text, row_number() OVER (ORDER BY digest) - 1 AS id, count(*) OVER () AS n FROM docs),
start AS (
  SELECT id, id AS x, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM rows),
{', '.join(walks)},
places AS ({' UNION ALL '.join(names)})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, x // {shards} AS slot, NULL::INT AS grown_shard
FROM rows JOIN places USING (id) JOIN crc USING (text)
"""
