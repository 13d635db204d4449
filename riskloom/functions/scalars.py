"""Small predicates and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_multiple(c: Column | str, modulus: int = 1000) -> Column:
    """True on whole multiples; a missing value is not one."""
    return F.coalesce(_col(c) % modulus == 0, F.lit(False))


def differs(c: Column | str, value: object) -> Column:
    """`c != value` where a missing value counts as different."""
    return ~_col(c).eqNullSafe(F.lit(value))


def at_least(c: Column | str, cut: float) -> Column:
    """1 from `cut` on, else 0."""
    return F.when(_col(c) >= cut, 1).otherwise(0)


def dummies(c: str, prefix: str, values: list) -> list[Column]:
    """One 0/1 column per declared value."""
    return [F.coalesce(F.col(c).eqNullSafe(F.lit(v)), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in values]


def share(part: Column | str, whole: Column | str) -> Column:
    return _col(part) / _col(whole)


def draw(key: Column | str, seed: int) -> Column:
    """A number in 0 .. 2^32-1 that depends on the key and the seed alone.

    Unlike a generator it gives each row the same number in every plan, on any number
    of partitions and after any retry.
    """
    return F.conv(F.substring(draw_text(key, seed), 1, 8), 16, 10).cast("long")


def draw_text(key: Column | str, seed: int) -> Column:
    """The same draw as 32 hexadecimal digits: text order is number order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


DRAWS = 1 << 32
