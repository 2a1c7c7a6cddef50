"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down the tree domain - language - source by weights. A child that cannot use its share
(its whole documents, repeated up to a number of epochs, hold fewer tokens) takes what it has, and its siblings
take the rest by their weights; only what all siblings together cannot use goes back to the level above. Each
leaf then takes a prefix of its token stream: epoch after epoch of its documents, each epoch in its own seeded
order, cut at the budget.

Scale. Counts per leaf are aggregated before they are shuffled. Orders within a leaf are never one task's
window: each leaf's order is dealt into ranges of about RANGE documents, ranges are summed, and only running
sums of ranges and of the documents of one range are taken. All arithmetic is in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import materialize

TOKEN = r"[^\x20\x09-\x0D]+"
RANGE = 2000
BROADCAST_LEAVES = 100_000  # budgets (under 100 bytes each) up to which they travel to the tasks; beyond, a join
LEVELS = ("domain", "lang", "source")
# Fixed values of the production mix: share of the corpus's tokens to take, epochs, seed and weights.
SHARE = (6, 10)
EPOCHS = 2
SEED = "mix-1"
DOMAINS = 3
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, tokens``; the domain is a bucket of the source's digest.

    Null language or source is a group named '?'. Null and wordless texts hold no tokens.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 7), 16, 10).cast("long") % DOMAINS).cast("string")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"),
        source.alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long").alias("tokens"),
    )


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out.cast("long")


def _share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give every child (``weight``, ``capacity``) its part of ``budget``, its parent's: column ``given``.

    Children in order of capacity to weight are filled as long as their capacity is at most their share of what
    is left; the others divide the rest by weight, and single tokens left by rounding go in order of name.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    order = by.orderBy(ratio.asc(), F.col(name).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    rows = (
        children.withColumn("budget", F.least("budget", F.sum("capacity").over(by)))
        .withColumn("left_w", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left_b", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    )
    full = F.col("capacity").cast(wide) * F.col("left_w") <= F.col("weight").cast(wide) * F.col("left_b")
    rows = rows.withColumn("full", full.cast("int"))
    rows = rows.withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest_w = F.sum(F.when(F.col("full") == 0, F.col("weight"))).over(by)
    rest_b = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full") == 1, F.col("capacity"))).over(by), F.lit(0))
    rows = rows.withColumn("rest_b", rest_b).withColumn("rest_w", rest_w)
    product = F.col("rest_b").cast(wide) * F.col("weight").cast(wide)
    part = F.when(F.col("full") == 1, F.col("capacity")).otherwise(((product - product % F.col("rest_w").cast(wide)) / F.col("rest_w").cast(wide)).cast("long"))
    rows = rows.withColumn("part", part)
    spare = (F.col("budget") - F.sum("part").over(by)).cast("long")
    place = F.row_number().over(by.orderBy("full", F.col(name)))
    return rows.withColumn("given", F.col("part") + F.when((F.col("full") == 0) & (place <= spare), 1).otherwise(0)).drop(
        "left_w", "left_b", "full", "rest_b", "rest_w", "part", "budget"
    )


def budgets(counts: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``domain, lang, source, docs, held, given``: each leaf's documents, tokens and budget."""
    leaves = materialize(
        counts.where("tokens > 0").groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("held")).withColumn("capacity", F.col("held") * epochs)
    )
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("held").alias("held"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("held").alias("held"))
    total = F.sum("held").over(Window.partitionBy(F.lit(0)))
    tops = domains.withColumn("weight", _weight("domain", DOMAIN_WEIGHTS)).withColumn("budget", F.floor(total * share[0] / share[1]).cast("long"))
    tops = _share_out(tops, [], "domain").select("domain", F.col("given").alias("budget"))
    mids = langs.withColumn("weight", _weight("lang", LANG_WEIGHTS)).join(tops, "domain")
    mids = _share_out(mids, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    last = leaves.withColumn("weight", F.lit(1).cast("long")).join(mids, ["domain", "lang"])
    return _share_out(last, ["domain", "lang"], "source").select(*LEVELS, "docs", "held", "given")


def mix(docs: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The chosen documents: ``doc_id, domain, lang, source, epoch, tokens, take_tokens``.

    One row for each document and epoch it is taken in. ``take_tokens`` is less than ``tokens`` only for the
    document at which a leaf's budget ends. Documents without a token are never taken. Ties of the seeded order
    (repeated ids) go by token count; rows alike in both share their places. An empty table gives no rows.
    """
    counts = materialize(token_counts(docs))
    leaves = materialize(budgets(counts, share, epochs).where("given > 0"))
    few = leaves.count() <= BROADCAST_LEAVES
    rows = counts.where("tokens > 0").join(F.broadcast(leaves) if few else leaves, list(LEVELS))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(epochs - 1), F.ceil(F.col("given") / F.col("held")).cast("int") - 1))))
    # what is left of the leaf's budget when the epoch begins; a whole epoch needs no order
    rows = rows.withColumn("left", F.col("given") - F.col("epoch") * F.col("held"))
    whole = rows.where("left >= held").withColumn("take_tokens", F.col("tokens"))
    part = rows.where("left < held").withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))))
    ranges = F.ceil(F.col("docs") / RANGE)
    part = materialize(part.withColumn("range", F.floor(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * ranges / F.lit(1 << 28)).cast("long")))
    leaf = Window.partitionBy(*LEVELS, "epoch").orderBy("range")
    sums = part.groupBy(*LEVELS, "epoch", "range").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(leaf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*LEVELS, "epoch", "range").orderBy("place", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = part.join(sums, [*LEVELS, "epoch", "range"]).where("base < left")
    part = part.withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    part = part.withColumn("take_tokens", F.least(F.col("tokens"), F.col("left") - F.col("before"))).where("take_tokens > 0")
    out = ["doc_id", *LEVELS, "epoch", "tokens", "take_tokens"]
    return whole.select(out).unionByName(part.select(out))


ORACLE_SQL = r"""
WITH counts AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM {docs}),
c AS (SELECT *, 'd' || (('0x' || substr(md5(source), 1, 7))::BIGINT % 3)::VARCHAR AS domain FROM counts),
leaves AS (
  SELECT domain, lang, source, count(*) AS docs, sum(tokens)::BIGINT AS held, 2 * sum(tokens)::BIGINT AS capacity
  FROM c WHERE tokens > 0 GROUP BY ALL),
n1 AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight,
         (SELECT sum(held)::BIGINT FROM leaves) * 6 // 10 AS budget, 0 AS p, domain AS name
  FROM leaves GROUP BY domain),
{one},
n2 AS (
  SELECT l.domain, lang, sum(l.capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight,
         any_value(g.given) AS budget, l.domain AS p, lang AS name
  FROM leaves l JOIN g1 g USING (domain) GROUP BY l.domain, lang),
{two},
n3 AS (
  SELECT l.*, 1 AS weight, g.given AS budget, l.domain || '/' || l.lang AS p, source AS name FROM leaves l JOIN g2 g USING (domain, lang)),
{three},
e AS (
  SELECT c.doc_id, c.domain, c.lang, c.source, c.tokens, epoch::INT AS epoch, given - epoch * held AS l, held,
         md5('mix-1:' || epoch || ':' || c.doc_id) AS place
  FROM c JOIN g3 USING (domain, lang, source), range(2) r(epoch) WHERE c.tokens > 0 AND given - epoch * held > 0),
t AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT doc_id, domain, lang, source, epoch, tokens, least(tokens, l - b)::BIGINT AS take_tokens FROM t WHERE l - b > 0
"""

_LEVEL_SQL = """
a{k} AS (SELECT *, least(budget, sum(capacity) OVER (PARTITION BY p))::HUGEINT AS bud FROM n{k}),
b{k} AS (
  SELECT *, sum(weight) OVER (PARTITION BY p) - coalesce(sum(weight) OVER w, 0) AS lw, bud - coalesce(sum(capacity) OVER w, 0) AS lb
  FROM a{k} WINDOW w AS (PARTITION BY p ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{k} AS (
  SELECT *, min(CASE WHEN capacity::HUGEINT * lw <= weight::HUGEINT * lb THEN 1 ELSE 0 END)
            OVER (PARTITION BY p ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM b{k}),
r{k} AS (
  SELECT *, bud - coalesce(sum(CASE WHEN filled = 1 THEN capacity END) OVER (PARTITION BY p), 0) AS rb,
         sum(CASE WHEN filled = 0 THEN weight END) OVER (PARTITION BY p) AS rw FROM f{k}),
s{k} AS (SELECT *, CASE WHEN filled = 1 THEN capacity ELSE rb * weight // rw END AS part FROM r{k}),
g{k} AS (
  SELECT * EXCLUDE (budget), (part + CASE WHEN filled = 0 AND row_number() OVER (PARTITION BY p ORDER BY filled, name)
         <= bud - sum(part) OVER (PARTITION BY p) THEN 1 ELSE 0 END)::BIGINT AS given FROM s{k})
"""


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix`` with its production parameters."""
    levels = [_LEVEL_SQL.replace("{k}", str(k)).strip() for k in (1, 2, 3)]
    return ORACLE_SQL.replace("{docs}", docs).replace("{one}", levels[0]).replace("{two}", levels[1]).replace("{three}", levels[2])
