"""Numbers in text, in floating point and in tables that two engines must agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a CSV reader takes for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EPSILON = 2.0**-52
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def parse_number(text: Column) -> Column:
    """A double from text: blanks and no-break spaces go, a comma is a decimal point; null where that leaves no number."""
    bare = F.replace(F.translate(F.btrim(text, F.lit(" \t\r\n\x0b\x0c")), "  ", ""), F.lit(","), F.lit("."))
    huge = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.isin(*NA_TOKENS), None).when(bare.rlike(NUMBER), bare.try_cast("double")).when(bare.rlike(INFINITE), huge)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ulp(x: Column) -> Column:
    """Distance from |x| to the next larger double, for normal numbers."""
    exponent = F.floor(F.log2(F.abs(x)))
    # log2 may round up to a whole number just below a power of two
    exponent = exponent - (F.pow(F.lit(2.0), exponent) > F.abs(x)).cast("int")
    return F.pow(F.lit(2.0), exponent - 52)


def quantised(x: Column, unit: float = 1e-6) -> Column:
    """x in whole units, so that rounding noise of sums in another order does not show; no negative zero."""
    return F.floor(x / F.lit(unit) + F.lit(0.501)).cast("long")


def coordinate_tolerance(low: Column, high: Column) -> Column:
    return F.lit(64 * EPSILON) * F.greatest(F.lit(1.0), F.abs(low), F.abs(high), F.abs(high - low))
