"""Column helpers that fix the engine's numeric conventions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round6(x) -> Column:
    """Six decimals, ties to even on the scaled double, as numpy rounds."""
    return F.rint(col(x) * 1e6) / 1e6


def no_nan(x) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(col(x)), col(x))


def clip(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def clip_cast(x, kind: str) -> Column:
    """A cast to an integer type that first clips to its range (PRJ19)."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind]
    top = 2 ** (bits - 1) - 1
    safe = float(top) if bits < 64 else 9.223372036854774e18
    return clip(col(x), float(-top - 1), safe).cast(kind)


def percent(part, whole, digits: int = 2) -> Column:
    """100 * part / whole, half away from zero; NULL where whole is 0."""
    return F.round(F.try_divide(col(part).cast("decimal(30,10)"), F.nullif(col(whole).cast("decimal(30,10)"), F.lit(0).cast("decimal(30,10)"))).cast("decimal(38,12)") * 100, digits)


def seconds_between(start, end) -> Column:
    """Seconds from ``start`` to ``end`` (EXTRACT(EPOCH))."""
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / 1e6


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
