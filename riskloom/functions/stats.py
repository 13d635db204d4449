"""Named aggregates: the functions a caller may ask for by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skew(c: Column | str) -> Column:
    """Bias-adjusted sample skewness: NULL below three values, 0 without spread."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, F.nanvl(g1, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


BY_NAME: dict[str, Callable[[Column | str], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "skew": adjusted_skew,
    "count": F.count,
    "sum": F.sum,
    "nunique": F.count_distinct,
    "nunique_approx": F.approx_count_distinct,
}

# Needs the group's mean first, so it is not a single aggregate.
MEAN_ABSOLUTE_DEVIATION = "mad"
