"""Secrets in texts, with DataFrame functions only.

Base spans come from three patterns. The method adds candidate strings whose windows are too random for
their character class: the Shannon entropy of every window of a fixed width is kept up to date by adding the
incoming character's count and taking away the outgoing one's, and an allow-list suppresses known harmless
strings. Positions are code points, from 0, with the end exclusive.

Scale. A projection: no shuffle, no join, no Python. A text that a cheap test clears costs that test only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

# Candidate strings of the entropy method, its windows and thresholds in bits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS = 3.0
MIXED_BITS = 3.8
# Strings that are no secrets, whatever their entropy.
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|lorem|test|xxxx|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

KINDS = ("assign", "access", "hex", "entropy")

CHUNK = 512  # matches whose places are added up in one array
BLOCK = 1 << 14  # characters of a text that are redacted together
SLICE = 4096  # characters of a candidate looked into at once, beside the overlap
FIRST_CODE = 43  # of the characters a candidate may hold: from + to z
LANES, PER_LANE, LANE_BITS = 7, 12, 5  # integers, counts in each and bits of a count


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often a lambda function within names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, end, kind, length) of all matches: what lies between matches gives their places."""
    return _walk(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), None, kind)


def running(items: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All spans that ``step`` tells on its way over the items: from a running number and an item, the next number
    and an array of spans. Done in chunks, so that what is told is not copied again for every item."""

    def one(state: Column, item: Column) -> Column:
        at, told = step(state["at"], item)
        return F.struct(at.alias("at"), F.concat(state["out"], told).alias("out"))

    def whole(all_items: Column) -> Column:
        def chunk(state: Column, first: Column) -> Column:
            own = F.aggregate(F.slice(all_items, first, F.lit(CHUNK)), F.struct(state["at"].alias("at"), _none().alias("out")), one)
            return bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

        starts = F.when(F.size(all_items) > 0, F.sequence(F.lit(1), F.size(all_items), F.lit(CHUNK))).otherwise(F.expr("cast(array() as array<int>)"))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int,kind:int,size:int>>>)").alias("out"))
        return F.flatten(F.aggregate(starts, begin, chunk)["out"])

    return bound(items, whole)


def _walk(between: Column, found: Column, values: Column | None, kind: int) -> Column:
    sized = F.transform(F.arrays_zip(between.alias("gap"), found.alias("hit"), (found if values is None else values).alias("value")),
        lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("hit"), F.char_length(p["value"]).alias("size")))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        first = at + pair["gap"]
        last = first + pair["hit"]
        return last, F.array(F.struct(first.alias("start"), last.alias("end"), F.lit(kind).alias("kind"), pair["size"].alias("size")))

    return running(F.filter(sized, lambda p: p["hit"].isNotNull()), step)


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: in one walk by place, against the furthest end of what began before."""
    events = F.concat(
        F.transform(others, lambda s: F.struct(s["start"].alias("key"), F.lit(1).alias("other"), s.alias("span"))),
        F.transform(spans, lambda s: F.struct(s["end"].alias("key"), F.lit(0).alias("other"), s.alias("span"))),
    )

    def step(furthest: Column, event: Column) -> tuple[Column, Column]:
        other = event["other"] == 1
        kept = F.when(~other & (furthest <= event["span"]["start"]), F.array(event["span"])).otherwise(_none())
        return F.when(other, F.greatest(furthest, event["span"]["end"])).otherwise(furthest), kept

    return running(F.array_sort(events), step)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,kind:int,size:int>>)")


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, ordered by start, then kind as listed."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = _walk(F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), values, 0)
    assign = F.when(text.rlike(ASSIGN), F.filter(assign, lambda s: s["size"] >= ASSIGN_VALUE)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(_none())
    return F.concat(assign, access, hexes)


def window_entropy(candidate: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any window of ``width`` characters of ``candidate`` (ASCII from + to z).

    One pass: the counts of a window's characters, five bits each in LANES integers, and the sum of n log2 n change
    by the incoming and the outgoing character. A step costs the same however long the candidate is.
    """
    if not 0 < width < 1 << LANE_BITS:
        raise ValueError("a window's counts don't fit their lanes")
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST_CODE)
    gone = LANES * PER_LANE  # a code of no lane

    def scan(own: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(gone), width), F.slice(own, F.lit(1), F.greatest(F.lit(0), F.size(own) - width)))
        steps = F.transform(
            F.arrays_zip(F.filter(own, lambda c: (c >= 0) & (c < gone)).alias("new"), before.alias("old")),
            lambda s, i: F.struct(
                F.call_function("div", s["new"], F.lit(PER_LANE)).alias("lane"), (s["new"] % PER_LANE * LANE_BITS).alias("shift"),
                F.call_function("div", s["old"], F.lit(PER_LANE)).alias("old_lane"), (s["old"] % PER_LANE * LANE_BITS).alias("old_shift"), i.alias("i"),
            ),
        )
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), LANES).alias("n"), F.lit(0.0).alias("total"), F.lit(1e9).alias("low"))
        # what the n-th occurrence of a character adds to the sum of n log2 n; none for a character that is not there
        rise = F.array(*[F.lit(n * math.log2(n) - (n - 1) * math.log2(n - 1) if n > 1 else 0.0) for n in range(width + 2)])

        def count(lanes: Column, lane: Column, shift: Column) -> Column:
            return F.coalesce(F.call_function("shiftright", F.get(lanes, lane), shift).bitwiseAND(F.lit(31)).cast("int"), F.lit(0))

        def move(state: Column, s: Column) -> Column:
            same = F.when((s["lane"] == s["old_lane"]) & (s["shift"] == s["old_shift"]), F.lit(1)).otherwise(F.lit(0))
            leaving, coming = count(state["n"], s["old_lane"], s["old_shift"]), count(state["n"], s["lane"], s["shift"])
            total = state["total"] - F.get(rise, leaving) + F.get(rise, coming - same + 1)
            one = F.lit(1).cast("long")
            lanes = F.transform(state["n"], lambda x, k: x
                + F.when(k == s["lane"], F.call_function("shiftleft", one, s["shift"])).otherwise(F.lit(0))
                - F.when(k == s["old_lane"], F.call_function("shiftleft", one, s["old_shift"])).otherwise(F.lit(0)))
            # the total of the window that ended one character before
            low = F.when(s["i"] >= width, F.least(state["low"], state["total"])).otherwise(state["low"])
            return F.struct(lanes.alias("n"), total.alias("total"), low.alias("low"))

        least = F.aggregate(steps, start, move, lambda s: F.least(s["low"], s["total"]))
        return F.when(F.size(own) >= width, F.lit(math.log2(width)) - least / F.lit(float(width))).otherwise(F.lit(0.0))

    return bound(codes, scan)


def high_entropy(candidate: Column, least: Column, width: int = WINDOW) -> Column:
    """Whether some window of the candidate reaches ``least`` bits. Long candidates go in slices that overlap by a
    window less one character, so no array grows with the candidate; the first slice that reaches it ends the search."""
    slices = F.regexp_extract_all(candidate, F.lit(f"(?=(.{{1,{SLICE + width - 1}}})).{{1,{SLICE}}}"), F.lit(1))
    return F.exists(slices, lambda part: window_entropy(part, width) >= least)


def entropy_spans(text: Column) -> Column:
    """Candidate strings of mixed classes, not on the allow-list, with a window above their class's threshold.

    Two classes have a threshold: strings of hexadecimal digits, and strings of letters, digits and signs. Both need a
    letter and a digit: strings of letters alone are names and words far too often, numbers are no secrets.
    """
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    all_spans = _walk(F.split(text, CANDIDATE, -1), found, None, 3)

    def random_looking(word: Column) -> Column:
        is_hex = word.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        digits, letters = word.rlike("[0-9]"), word.rlike("[A-Za-z]")
        return digits & letters & ~word.rlike(ALLOWED) & high_entropy(word, F.when(is_hex, HEX_BITS).otherwise(MIXED_BITS))

    kept = F.filter(F.arrays_zip(all_spans.alias("span"), found.alias("word")), lambda p: random_looking(p["word"]))
    return F.when(text.rlike(CANDIDATE), F.transform(kept, lambda p: p["span"])).otherwise(_none())


def _ordered(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (start, end, kind number in KINDS).

    A null text counts as empty and has no spans. Entropy spans that overlap a base span are left out, since
    the string is reported already. Every row stays; repeated rows get equal results; an empty table gives no rows.
    Columns named ``secret_base`` and ``secret_spans`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = docs.withColumn("secret_base", base_spans(text)).withColumn("secret_more", entropy_spans(text))
    more = F.when(F.size("secret_more") > 0, apart_from(F.col("secret_more"), F.col("secret_base"))).otherwise(_none())
    return with_base.withColumn("secret_spans", _ordered(F.concat("secret_base", more))).withColumn("secret_base", _ordered(F.col("secret_base"))).drop("secret_more")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark`` and ``n_chars`` brought up to date; same columns.

    Spans that overlap become one mark. A null text stays null; an empty table stays empty; repeated rows get equal
    texts. Long texts are cut at fixed places, so a span costs no walk through the whole text.
    """
    scanned = scan(docs)

    def without(block: Column, number: Column, spans: Column) -> Column:
        first = number * BLOCK
        own = F.transform(
            F.filter(spans, lambda s: (s["start"] < first + BLOCK) & (s["end"] > first)),
            lambda s: F.struct(F.greatest(s["start"] - first, F.lit(0)).alias("start"), F.least(s["end"] - first, F.lit(BLOCK)).alias("end"), (s["start"] >= first).alias("marked")),
        )

        def cut(state: Column, span: Column) -> Column:
            """A span that overlaps the ones before only lengthens what they took."""
            apart = span["start"] >= state["end"]
            gap = F.substring(block, state["end"] + 1, span["start"] - state["end"])
            piece = F.concat(gap, F.when(span["marked"], F.lit(mark)).otherwise(F.lit("")))
            return F.struct(F.greatest(state["end"], span["end"]).alias("end"), F.when(apart, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<string>)").alias("out"))
        kept = F.aggregate(own, begin, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(block, s["end"] + 1, F.lit(BLOCK))))
        return F.when(F.exists(spans, lambda s: (s["start"] < first + BLOCK) & (s["end"] > first)), kept).otherwise(block)

    blocks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = bound(F.col("secret_spans"), lambda spans: F.array_join(F.transform(blocks, lambda b, k: without(b, k, spans)), ""))
    dirty = F.size("secret_spans") > 0
    out = scanned.withColumn("text", F.when(dirty, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(dirty, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


_SPANS_SQL = """
  SELECT doc_id, {kind} AS kind, '{name}' AS name, gap + before AS s, gap + before + len(hit) AS e, hit, value FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {
        'gap': list_sum(list_transform(gaps[1:i], lambda g: len(g))), 'before': coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0), 'hit': hits[i], 'value': vals[i]}), recursive := true)
    FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {group}) AS vals FROM texts))
"""


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the registered query. Windows' entropies are taken from scratch there."""

    def spans(kind: int, pattern: str, group: int = 0) -> str:
        quoted = "'" + pattern.replace("'", "''") + "'"
        return _SPANS_SQL.replace("{kind}", str(kind)).replace("{name}", KINDS[kind]).replace("{pattern}", quoted).replace("{group}", str(group))

    return (
        "WITH texts AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS t FROM documents),\nbase AS ("
        + f"SELECT * FROM ({spans(0, ASSIGN, 2)}) WHERE len(value) >= {ASSIGN_VALUE} UNION ALL {spans(1, ACCESS)} UNION ALL {spans(2, HEX)}),\n"
        + f"""words AS (SELECT * FROM ({spans(3, CANDIDATE)}) WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{ALLOWED}')),
bits AS (SELECT *, list_max(list_transform(range(1, len(hit) - {WINDOW - 2}), lambda i: list_sum(list_transform(list_distinct(string_split(substr(hit, i, {WINDOW}), '')),
    lambda c: -(len(list_filter(string_split(substr(hit, i, {WINDOW}), ''), lambda x: x = c)) / {WINDOW}.0) * log2(len(list_filter(string_split(substr(hit, i, {WINDOW}), ''), lambda x: x = c)) / {WINDOW}.0))))) AS h FROM words),
more AS (SELECT * FROM bits WHERE h >= CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN {HEX_BITS} ELSE {MIXED_BITS} END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = bits.doc_id AND b.s < bits.e AND bits.s < b.e)),
told AS (SELECT doc_id, kind, s, e, name || ':' || s || ':' || e AS x FROM base UNION ALL SELECT doc_id, kind, s, e, name || ':' || s || ':' || e FROM more),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
    string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b, string_agg(x, ',' ORDER BY s, kind) AS spans FROM told GROUP BY doc_id)
SELECT id AS doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN a USING (doc_id)"""
    )
