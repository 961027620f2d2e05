"""Wall-clock arithmetic on TIMESTAMP_NTZ columns.

Nothing here consults the session time zone: labels are naive local wall
clock and stay so.
"""

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 00:00 on the same wall clock."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def from_seconds(sec) -> Column:
    """Inverse of :func:`seconds`."""
    c = F.col(sec) if isinstance(sec, str) else sec
    day = F.floor(c / 86400).cast("int")
    rest = F.pmod(c, F.lit(86400)).cast("int")
    zero = F.lit(0)
    return F.expr(EPOCH) + F.make_dt_interval(day, zero, zero, rest.cast("decimal(18,6)"))


def floor_to(ts, minutes: int) -> Column:
    """Label of the half-open interval of ``minutes`` that holds ``ts``."""
    step = minutes * 60
    return from_seconds((F.floor(seconds(ts) / step) * step).cast("long"))


def shift(ts, minutes) -> Column:
    """``ts`` moved by a signed number of minutes (int or Column)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    zero = F.lit(0)
    return c + F.make_dt_interval(zero, zero, m.cast("int"), zero.cast("decimal(18,6)"))


def month_start(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.trunc(c.cast("date"), "month").cast("timestamp_ntz")


def day_start(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.cast("date").cast("timestamp_ntz")


def week_start(ts) -> Column:
    """Monday that opens the calendar week ending on Sunday."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.trunc(c.cast("date"), "week")


def month_label(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")


def season(ts) -> Column:
    """Meteorological season of the label's month."""
    c = F.col(ts) if isinstance(ts, str) else ts
    names = F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")])
    return F.element_at(names, (F.floor(F.month(c) % 12 / 3) + 1).cast("int"))


def nth_sunday(year: Column, month: int, ordinal: int) -> Column:
    """Date of the ``ordinal``-th Sunday of ``month``."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "SUN"), 7 * (ordinal - 1))


def spring_date(ts) -> Column:
    """Second Sunday of March: the hour from 02:00 does not exist."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return nth_sunday(F.year(c), 3, 2)


def fall_date(ts) -> Column:
    """First Sunday of November: the hour from 01:00 occurs twice."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return nth_sunday(F.year(c), 11, 1)


def fall_ambiguous(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c.cast("date") == fall_date(c)) & (F.hour(c) == 1)


def spring_nonexistent(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c.cast("date") == spring_date(c)) & (F.hour(c) == 2)


def resolvable(ts) -> Column:
    """True where the wall-clock label names exactly one instant."""
    return ~(fall_ambiguous(ts) | spring_nonexistent(ts))


def utc_offset_hours(ts, standard: float = -8.0) -> Column:
    """Civil UTC offset with one hour of daylight time; NULL when unresolvable."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = c.cast("date")
    after_spring = (day > spring_date(c)) | ((day == spring_date(c)) & (F.hour(c) >= 3))
    before_fall = (day < fall_date(c)) | ((day == fall_date(c)) & (F.hour(c) < 1))
    offset = F.when(after_spring & before_fall, F.lit(standard + 1.0)).otherwise(F.lit(standard))
    return F.when(resolvable(c), offset)
