"""Exact decimal amounts: strict parsing, rounding, cash rounding and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the grammar of an amount. No exponent, no leading zero, no plus sign; zero has no sign.
AMOUNT = r"^(?!-0(\.0+)?$)-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
DIGITS = 38
WIDE = "decimal(38,0)"


def accepted(text: Column) -> Column:
    """Whether a text is an amount: the grammar, and DIGITS digits at most, wherever its point stands."""
    return text.rlike(AMOUNT) & (F.char_length(F.regexp_replace(text, r"[-.]", "")) <= DIGITS)


def parse_amount(text: Column, scale: int = 18) -> Column:
    """The amount of a text as a decimal of ``scale`` places; null where it is not accepted, would lose digits, or has more
    than DIGITS - ``scale`` digits before the point (``parse_amount_text`` keeps those, too)."""
    fraction = F.regexp_extract(text, r"\.([0-9]*?)0*$", 1)
    good = accepted(text) & (F.char_length(fraction) <= scale)
    return F.when(good, text.try_cast(f"decimal({DIGITS},{scale})"))


def parse_amount_text(text: Column) -> Column:
    """The amount of a text as its shortest text, all of up to DIGITS digits kept; null where it is not accepted."""
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(accepted(text), short)


def round_amount(amount: Column, scale: int, mode: str = "half_away") -> Column:
    """Round to ``scale`` places: ties away from zero (``half_away``) or to the even digit (``half_even``)."""
    if mode not in ("half_away", "half_even"):
        raise ValueError(f"rounding mode {mode}")
    return F.round(amount, scale) if mode == "half_away" else F.bround(amount, scale)


def format_amount(amount: Column, scale: int) -> Column:
    """Text with exactly ``scale`` places; zero has no sign."""
    return F.round(amount, scale).cast(f"decimal(38,{scale})").cast("string")


def round_units(units: Column, multiple: int, mode: str = "half_away") -> Column:
    """Whole minor units rounded to a multiple of ``multiple`` units (cash), in integers."""
    if multiple <= 0:
        raise ValueError("the cash unit is not positive")
    size, base = F.abs(units), F.lit(multiple)
    down, rest = F.call_function("div", size, base), size % base
    up = F.when(rest * 2 > base, 1).when(rest * 2 < base, 0).otherwise(F.lit(1) if mode == "half_away" else down % 2)
    return F.signum(units).cast("long") * (down + up) * multiple


def allocate(rows: DataFrame, group: list[str], total: str, weight: str, order: list[str], part: str = "part") -> DataFrame:
    """Split each group's ``total`` (whole minor units, the same in its rows) by ``weight`` into whole units.

    Every row gets the floor of its share of the magnitude; the units left go to the largest remainders, earlier rows
    (``order``) first on ties; a negative total is split by its magnitude. Groups whose weights sum to zero, or
    that hold a negative weight, can't be split and get null. Parts sum to the total exactly.
    """
    by = Window.partitionBy(*group)
    size, share = F.abs(F.col(total)).cast(WIDE), F.col(weight).cast(WIDE)
    rows = rows.withColumn("_sum", F.when(F.min(share).over(by) >= 0, F.sum(share).over(by))).withColumn("_product", size * share)
    whole = ((F.col("_product") - F.col("_product") % F.col("_sum")) / F.col("_sum")).cast("long")
    rows = rows.withColumn("_base", F.when(F.col("_sum") > 0, whole)).withColumn("_rest", F.when(F.col("_sum") > 0, F.col("_product") % F.col("_sum")))
    left = F.abs(F.col(total)) - F.sum("_base").over(by)
    place = F.row_number().over(by.orderBy(F.col("_rest").desc(), *order))
    value = F.col("_base") + F.when(place <= left, 1).otherwise(0)
    return rows.withColumn(part, F.when(F.col(total) < 0, -value).otherwise(value).cast("long")).drop("_sum", "_product", "_base", "_rest")
