"""Looking at tables: counts, profiles, drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.joins import present_in


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of different values of each column, in one row."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def distinct_values(df: DataFrame, column: str, where: Column | None = None, ascending: bool = True) -> DataFrame:
    """The values of a column among the chosen rows, sorted."""
    chosen = df if where is None else df.where(where)
    return chosen.select(column).distinct().orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: its type and how many values it has."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(name).alias("non_null"))
            for name, kind in df.dtypes
        ]
    )
    return counts.select(F.inline(lines))


def drill_down(
    logins: DataFrame, trades: DataFrame, device: object, user: object | None = None, ascending: bool = True
) -> tuple[DataFrame, DataFrame]:
    """All logins of a device in time order, narrowed to one user if given, and the trades of those users."""
    seen = logins.where(F.col("device") == F.lit(device))
    theirs = trades
    if user is None:
        theirs = present_in(trades, seen, ["id"])
    else:
        seen = seen.where(F.col("id") == F.lit(user))
        theirs = trades.where(F.col("id") == F.lit(user))
    order = F.col("time").asc() if ascending else F.col("time").desc()
    return seen.orderBy(order, "log_id"), theirs
