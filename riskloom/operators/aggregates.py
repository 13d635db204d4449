"""Grouped aggregates. All are combined before their shuffle, so a hot key does no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import moments
from riskloom.functions.scalars import differs, is_multiple
from riskloom.functions.stats import BY_NAME, MEAN_ABSOLUTE_DEVIATION
from riskloom.operators.hotkeys import hot_keys, with_group_values

Names = str | list[str]


def _listed(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def distinct_keys(df: DataFrame, by: str = "id") -> DataFrame:
    return df.select(by).where(F.col(by).isNotNull()).distinct()


def aggregate(
    df: DataFrame, columns: Names, functions: Names, by: str = "id", hot: DataFrame | None | bool = True
) -> DataFrame:
    """Several functions of several columns per key, as `<column>_<function>`."""
    return aggregate_many(df, [(columns, functions)], by, hot)


def aggregate_many(
    df: DataFrame, wanted: list[tuple[Names, Names]], by: str = "id", hot: DataFrame | None | bool = True
) -> DataFrame:
    """As `aggregate`, for several (columns, functions) pairs at once.

    `mad` is the mean absolute deviation about the mean. It needs the group's mean on
    each row first; when asked for, that is added ahead of the same grouping. Mean, variance and deviation of columns of
    whole numbers come from exact sums (`moments`), and with a `mad` their skewness as well.
    """
    pairs = [(c, f) for columns, functions in wanted for c in _listed(columns) for f in _listed(functions)]
    df = df.where(F.col(by).isNotNull())
    about_mean = list(dict.fromkeys(c for c, f in pairs if f == MEAN_ABSOLUTE_DEVIATION))
    exact = {c for c, f in pairs if about_mean and f in moments.NAMES and moments.is_whole(df, c)}
    carried = {f"_mean_{c}": F.avg(c) for c in about_mean if c not in exact}
    for c in sorted(exact):
        carried |= moments.centre(c)
    plain = with_group_values(df, [by], carried, hot) if carried else df
    centred = {c: moments.centred(c) for c in exact}

    def one(c: str, f: str) -> Column:
        if c in exact and f in moments.NAMES:
            return centred[c][f]
        if f == MEAN_ABSOLUTE_DEVIATION:
            return F.avg(F.abs(F.col(c) - F.col(f"_mean_{c}")))
        if f in ("mean", "var", "std") and moments.is_whole(df, c):
            return moments.one_pass(c)[f]
        return BY_NAME[f](c)

    named = {f: {f"{c}_{f}": one(c, f) for c, g in pairs if g == f} for _, f in pairs}
    different = named.pop("nunique", {})
    out = group(plain, {n: a for part in named.values() for n, a in part.items()}, different, by, df)
    return out.select(by, *[f"{c}_{f}" for c, f in pairs])


def group(
    df: DataFrame,
    plain: dict[str, Column],
    different: dict[str, Column],
    by: str = "id",
    different_of: DataFrame | None = None,
) -> DataFrame:
    """One grouping for plain aggregates, one for counts of different values, joined on the key.

    Spark multiplies the rows by the number of columns it counts different values of.
    Kept apart, that happens to the counted columns only; both sides end up laid out by
    the key, so the join moves nothing. `different_of` may name a narrower table for it.
    Rows without key belong to no group.
    """

    def one(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
        return rows.where(F.col(by).isNotNull()).groupBy(by).agg(*[a.alias(n) for n, a in aggregates.items()])

    rows = df if different_of is None else different_of
    if not different:
        return one(df, plain)
    if not plain:
        return one(rows, different)
    return one(df, plain).join(one(rows, different), by)


def whole_second_counts(df: DataFrame, column: str = "timelong", modulus: int = 1000, by: str = "id") -> DataFrame:
    """Per user: rows whose duration is, and is not, a whole second. Pivot form."""
    return (
        df.where(F.col(by).isNotNull())
        .withColumn("_whole", is_multiple(column, modulus))
        .groupBy(by)
        .pivot("_whole", [False, True])
        .count()
        .na.fill(0)
        .withColumnsRenamed({"false": "whole_sec_false", "true": "whole_sec_true"})
    )


def whole_second_aggregates(
    column: str = "timelong", modulus: int = 1000, prefix: str = "whole_sec", names: tuple[str, str] = ("false", "true")
) -> dict[str, Column]:
    """The same counts as plain aggregates, to sit with others in one grouping."""
    whole = is_multiple(column, modulus)
    return {f"{prefix}_{names[0]}": F.count_if(~whole), f"{prefix}_{names[1]}": F.count_if(whole)}


def failed_login_aggregates(result: str = "result", success: object = 1) -> tuple[Column, Column]:
    """Failed logins with a known result, and whether the user has any row that is not a success."""
    failed = differs(result, success)
    return F.count(F.when(failed, F.col(result))), F.count_if(failed) > 0


def failed_login_counts(df: DataFrame, by: str = "id", result: str = "result", success: object = 1) -> DataFrame:
    """Per user with a failed login, how many. Users without one have no row."""
    return (
        df.where(differs(result, success) & F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count(result).alias("result_no1_Counts"))
    )


def add_failed_logins(users: DataFrame, df: DataFrame, by: str = "id") -> DataFrame:
    """Add the failed-login count; users without one go, and missing numbers become 0."""
    out = users.join(failed_login_counts(df, by), by)
    return out.na.fill(0, [c for c in out.columns if c != by])


def usage_share(
    df: DataFrame, column: str, by: str = "id", key: str = "log_id", hot: DataFrame | None | bool = True
) -> DataFrame:
    """Per user and value: the share of the user's rows that have this value, as `<column>_scale`.

    The user's total is summed from the counts, not from the rows. `hot` is the hot keys
    of the rows: where no user has too many rows, none has too many values.
    """
    if hot is True:
        hot = hot_keys(df, [by])
    counts = (
        df.where(F.col(by).isNotNull() & F.col(column).isNotNull())
        .groupBy(by, column)
        .agg(F.count(key).alias("_n"))
    )
    counts = with_group_values(counts, [by], {"_all": F.sum("_n")}, hot)
    return counts.select(by, column, (F.col("_n") / F.col("_all")).alias(f"{column}_scale"))


def usual_hour(df: DataFrame, time: str = "time", by: str = "id") -> DataFrame:
    """Per user: mean, deviation and variance of the login hour, each hour of a day counted once."""
    hours = (
        df.select(by, F.to_date(time).alias("_date"), F.hour(time).alias("_hour"))
        .dropna()
        .distinct()
    )
    return hours.groupBy(by).agg(
        F.avg("_hour").alias("l_time_mean"),
        F.stddev_samp("_hour").alias("l_time_std"),
        F.var_samp("_hour").alias("l_time_var"),
    )


def logins_per_hour(df: DataFrame, time: str = "time", by: str = "id", key: str = "log_id") -> DataFrame:
    """Distinct logins per user, day and hour."""
    return (
        df.select(by, F.to_date(time).alias("date"), F.hour(time).alias("hour"), key)
        .dropna(subset=[by, "date", "hour"])
        .groupBy(by, "date", "hour")
        .agg(F.count_distinct(key).alias(key))
    )


def row_of_max(df: DataFrame, by: list[str], value: str, tie: str, columns: list[str]) -> DataFrame:
    """Per group, the columns of the row with the largest value; the lowest `tie` among equals.

    With an empty `by` the one row of the whole table. `value` is a number; rows without it, or without a key, take
    no part.
    """
    # One pass: the smallest of (-value, tie) carries the row along. NaN counts as the largest value.
    place = [F.isnan(value) == F.lit(False)] if df.schema[value].dataType.typeName() in ("double", "float") else []
    row = F.struct(*[F.col(c) for c in dict.fromkeys([tie, *columns])])
    known = df.where(" and ".join(f"`{c}` is not null" for c in [value, *by]))
    top = known.groupBy(*by).agg(F.min_by(row, F.struct(*place, -F.col(value), F.col(tie))).alias("_row"))
    return top.where(F.col("_row").isNotNull()).select(*by, *[f"_row.{c}" for c in columns])
