"""Times as text, parts of a time, and gaps between times.

A gap is held in microseconds. Its day part is floored and its seconds part is the
rest within that day, so one hour back is day -1 and second 82800.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of_text(c: Column | str) -> Column:
    """Hour out of a time held as text; NULL where there is none."""
    return F.regexp_extract(_col(c), r"\s(\d\d):", 1).try_cast("int")


def to_seconds_text(c: Column | str) -> Column:
    """The first 19 characters: `yyyy-MM-dd HH:mm:ss`."""
    return F.substring(_col(c), 1, 19)


def parse(c: Column | str, pattern: str | None = None) -> Column:
    """Text to a time without zone, NULL where it cannot be read.

    Without a pattern any ISO form is taken; `y-M-d H:m:s` style patterns also take
    unpadded fields.
    """
    if pattern is None:
        return _col(c).try_cast("timestamp_ntz")
    readable = F.try_to_timestamp(_col(c), F.lit(pattern)).isNotNull()
    return F.when(readable, F.to_timestamp_ntz(_col(c), F.lit(pattern)))


def gap_us(earlier: Column | str, later: Column | str) -> Column:
    """Gap in microseconds, on the times' own clock whatever the session's time zone."""
    seconds = (_col(later) - _col(earlier)).cast("interval second").cast("decimal(18,6)")
    return (seconds * SECOND_US).cast("long")


def instant_us(c: Column | str) -> Column:
    """Microseconds since 1970, in the time's own clock."""
    return gap_us(F.lit("1970-01-01").cast("timestamp_ntz"), c)


def gap_days(us: Column | str) -> Column:
    us = _col(us)
    return ((us - F.pmod(us, F.lit(DAY_US))) / DAY_US).cast("long")


def gap_seconds(us: Column | str) -> Column:
    return F.floor(F.pmod(_col(us), F.lit(DAY_US)) / SECOND_US)


def whole_seconds(c: Column | str) -> Column:
    """The time cut down to its second."""
    c = _col(c)
    return F.timestamp_add("MICROSECOND", -F.pmod(instant_us(c), F.lit(SECOND_US)), c)
