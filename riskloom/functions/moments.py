"""Statistics of whole numbers from exact sums.

Sums of doubles depend on the order of the rows in their last digits, hence on layout, retries and merging. Sums of
whole numbers do not. So numbers, their squares and cubes are summed as decimals, and each statistic is one formula on these
sums: the same bits however the rows were dealt.

`one_pass` needs the sums alone and is combined before a shuffle. `centred` works on rows that carry their group's
count and sum (`centre`), takes the distance from the whole part of the mean, and so serves skewness and mean
absolute deviation as well. Distances up to 2 * 10^12 are cubed exactly, a cube being summed in two halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("mean", "var", "std", "skew", "mad")
_HALF = 10**18
_WIDE = "decimal(19,0)"


def is_whole(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")


def _wide(c: Column) -> Column:
    return c.cast(_WIDE)


def _double(c: Column) -> Column:
    return c.cast("double")


def _spread(n: Column, first: Column, second: Column) -> Column:
    """n * (sum of squares) - (sum) ** 2 as a double; exact before that unless it needs more than 38 digits."""
    exact = F.try_subtract(F.try_multiply(_wide(n), second), F.try_multiply(first, first))
    return F.coalesce(_double(exact), _double(n) * _double(second) - _double(first) * _double(first))


def _variance(n: Column, spread: Column) -> Column:
    return F.when(n > 1, spread / (_double(n) * _double(n - 1)))


def one_pass(c: str) -> dict[str, Column]:
    """Aggregates mean, var and std (of a sample) of a column of whole numbers."""
    x = _wide(F.col(c))
    n, first = F.count(c), F.sum(x)
    var = _variance(n, _spread(n, first, F.sum(x * x)))
    return {"mean": _double(first) / _double(n), "var": var, "std": F.sqrt(var)}


def centre(c: str) -> dict[str, Column]:
    """Aggregates that `centred` wants on each row."""
    return {f"_n_{c}": F.count(c), f"_s_{c}": F.sum(_wide(F.col(c)))}


def centred(c: str) -> dict[str, Column]:
    """Aggregates mean, var, std, skew (adjusted) and mad of rows that carry the columns of `centre`."""
    every_n, every_sum = F.col(f"_n_{c}"), F.col(f"_s_{c}")
    distance = f"cast(`{c}` - `_s_{c}` div nullif(`_n_{c}`, 0) as {_WIDE})"  # from the whole part of the mean
    cube = f"{distance} * {distance} * {distance}"
    d = F.expr(distance)
    n, first, second = F.count(c), F.sum(d), F.sum(d * d)
    high, low = (F.sum(F.expr(f"cast(({cube}) {op} {_HALF} as decimal(38,0))")) for op in ("div", "%"))
    third = _double(high) * float(_HALF) + _double(low)
    count, rest = _double(n), _double(first) / _double(n)
    var = _variance(n, _spread(n, first, second))
    m2 = var * (count - 1) / count
    m3 = third / count - 3 * rest * _double(second) / count + 2 * rest * rest * rest
    skew = F.when(n >= 3, F.when(m2 > 0, m3 / (m2 * F.sqrt(m2)) * F.sqrt(count * (count - 1)) / (count - 2)).otherwise(0.0))
    away = F.sum(F.abs(_wide(every_n) * _wide(F.col(c)) - every_sum))
    return {
        "mean": F.max(_double(every_sum) / _double(every_n)), "var": var, "std": F.sqrt(var), "skew": skew,
        "mad": _double(away) / (count * count),
    }
