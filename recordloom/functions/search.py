"""Search text: folded values with readings, and literal matching of folded queries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

UNIT, VALUES = "\x1f", "\x1e"  # between a value's forms, and between values


def fold_text(text: str) -> str:
    """Compatibility composition, lower case, without control and format characters."""
    lowered = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in lowered if c.isprintable() or unicodedata.category(c) not in ("Cc", "Cf"))


@pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold_text(t))


def search_text(readings: dict[str, str], *values: Column) -> Column:
    """Each value's folded form, full reading and initials; characters without a reading stand for themselves.

    ``readings`` maps a character to its reading; the caller supplies it, and its size is that of a script.
    """

    @pandas_udf(StringType())
    def forms(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> str | None:
            if t is None:
                return None
            folded = fold_text(t)
            read = [readings.get(c, c) for c in folded]
            full = "".join(read)
            first = "".join(r[:1] for r in read)
            return UNIT.join([folded, full, first]) if full != folded else folded

        return text.map(of)

    return F.array_join(F.array_compact(F.array(*[forms(v) for v in values])), VALUES)


def query_text(text: str) -> str:
    return fold_text(text).strip()


def matches(searchable: Column, query: str) -> Column:
    """Whether any form of any value holds the folded query literally; an empty query matches everything."""
    wanted = query_text(query)
    return searchable.contains(wanted) if wanted else F.lit(True)
