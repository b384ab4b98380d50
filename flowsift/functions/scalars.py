"""Column helpers shared by the operators. All are built-in expressions, none is a UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

FLOATS = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]


def q(name: str) -> Column:
    """Column by exact name, also where the name has dots, slashes or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities, so that NULL is the only missing value."""
    return F.when(F.isnan(c) | (F.abs(c) == INF), None).otherwise(c)


def scored(c: Column) -> Column:
    """A score as double, NULL where it is missing or NaN: Spark orders NaN above all numbers."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def round_even(c: Column, digits: int) -> Column:
    """Multiply, round half to even, divide: numpy's rounding formula."""
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(0.0)


def number_or_zero(c: Column) -> Column:
    """Parse as a number. Unparseable, missing and NaN become 0.

    Java's parser takes a type suffix (``1d``, ``2f``); such text is no number here.
    """
    text = F.trim(c.cast("string"))
    parsed = F.when(~F.lower(text).rlike(r"[0-9.][df]$"), text.try_cast("double"))
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def count_where(cond: Column) -> Column:
    """Rows where ``cond`` is true, 0 (not NULL) on empty input."""
    return F.count(F.when(cond, 1))


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)
