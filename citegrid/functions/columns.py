"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_AUTHOR = "A9999999999"
DELETED_AUTHOR = "A5317838346"


def short_id(c: Column) -> Column:
    """The last part of an id between slashes (NZ3)."""
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def truthy(c: Column) -> Column:
    """Whether text says yes: true, 1, yes or y."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def to_double(c: Column) -> Column:
    """A number from text, with a comma as decimal point allowed; null if it is none."""
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def to_long(c: Column) -> Column:
    """A whole number from text; fractions are cut off."""
    return c.try_cast("double").try_cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def significant(c: Column) -> Column:
    """A number to three significant digits as text, as ``%.3g`` writes it in C; null of null."""
    zeros = r"(\.[0-9]*[1-9])0+$|\.0+$"
    power = F.floor(F.log10(F.abs(c)))
    lead = F.bround(c / F.pow(F.lit(10.0), power), 2)
    over = F.abs(lead) >= 10  # 9.996 becomes 10.0
    power, lead = power + over.cast("int"), F.when(over, lead / 10).otherwise(lead)
    plain = F.regexp_replace(F.format_string("%.8f", lead * F.pow(F.lit(10.0), power)), zeros, "$1")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    short = F.concat(F.regexp_replace(F.format_string("%.2f", lead), zeros, "$1"), exponent)
    return F.when(c == 0, "0").when(power.between(-4, 2), plain).when(c.isNotNull(), short)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def finite(c: Column) -> Column:
    """The number, or 0 if it is null, infinite or not a number."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
