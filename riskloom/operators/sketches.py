"""Distinct counts that can be merged: sketches stored per key and day instead of the values themselves.

An exact distinct count has to bring all (key, value) pairs together, each time anew. A sketch of bounded size per key
and day is written once as the days come in, and any span of days is counted by merging what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K = 12  # a sketch has 2 ** LOG_K cells; its relative standard error is about 1.04 / 2 ** (LOG_K / 2), 1.6 %


def relative_error(log_k: int = LOG_K, deviations: float = 3.0) -> float:
    """Bound that an estimate exceeds about as seldom as a normal variable exceeds so many deviations."""
    return deviations * 1.04 / 2 ** (log_k / 2)


def daily_sketches(
    df: DataFrame, columns: list[str], by: str = "id", time: str = "time", log_k: int = LOG_K
) -> DataFrame:
    """Per key and day a sketch of each column, as `<column>_sketch`. Rows without key or time have no day to go to."""
    known = df.where(F.col(by).isNotNull() & F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    return known.groupBy(by, "day").agg(*[F.hll_sketch_agg(c, log_k).alias(f"{c}_sketch") for c in columns])


def merged_counts(sketches: DataFrame, columns: list[str], by: str = "id") -> DataFrame:
    """Per key the estimated number of different values over all its days, as `<column>_Counts`, and the days."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_Counts") for c in columns]
    return sketches.groupBy(by).agg(F.count(F.lit(1)).alias("days"), *counts)
