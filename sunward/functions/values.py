"""Missing and non-finite values, and small value helpers."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

INFINITY = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """The value, or NULL when it is NULL, NaN or infinite."""
    c = _c(x)
    return F.when(is_finite(c), c)


def is_finite(x) -> Column:
    """False (never NULL) for NULL, NaN and the infinities."""
    c = _c(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INFINITY))


def holds(condition: Column) -> Column:
    """A condition where unknown counts as not met."""
    return F.coalesce(condition, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, [holds(c) for c in conditions])


def ratio(numerator, denominator) -> Column:
    """Numerator over a positive denominator; NULL otherwise."""
    d = _c(denominator)
    return F.when(d > 0, _c(numerator) / d)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def strict_greatest(*cols) -> Column:
    """Largest of the columns, NULL as soon as one of them is NULL."""
    cs = [_c(x) for x in cols]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cs])
    return F.when(known, F.greatest(*cs))


def circular_difference(a, b) -> Column:
    """Smallest angle between two directions in degrees."""
    d = F.abs(_c(a) - _c(b))
    return F.least(d, 360.0 - d)


def to_celsius(fahrenheit) -> Column:
    return (_c(fahrenheit) - 32.0) * 5.0 / 9.0


def to_metres_per_second(miles_per_hour) -> Column:
    return _c(miles_per_hour) * 0.44704


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of ``df`` next to the single row of an ungrouped aggregate.

    One row is the proven size of the broadcast side.
    """
    return df.join(F.broadcast(row), F.lit(True))
