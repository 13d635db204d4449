"""Joins between the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clock
from riskloom.operators.hotkeys import LANE, attach, only_hot, with_lanes


def link_asof(
    trades: DataFrame,
    logins: DataFrame,
    take: dict[str, str] | None = None,
    by: str = "id",
    time: str = "time",
    trade_key: str = "rowkey",
    login_key: str = "log_id",
    truncate_seconds: bool = False,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Give every trade the same user's latest login before it.

    Every trade is kept once. The link is `login_id`, NULL where no login is earlier;
    `take` adds further login columns, as {new name: login column}. Earlier is strict:
    a login at the trade's own instant does not count. Among logins at one instant the
    lowest key is taken. `truncate_seconds` compares both times cut to the second.

    Both logs are put in one time order per user and the last login seen is carried
    along, so the cost is one shuffle and one sort, however many logins a user has.
    """
    return link_timeline(timeline(trades, logins, take, by, time, trade_key, login_key, truncate_seconds), by, hot)


def timeline(
    trades: DataFrame,
    logins: DataFrame,
    take: dict[str, str] | None = None,
    by: str = "id",
    time: str = "time",
    trade_key: str = "rowkey",
    login_key: str = "log_id",
    truncate_seconds: bool = False,
) -> DataFrame:
    """Both logs in one form: what `link_timeline` wants to know of each row.

    Stored as one table laid out by user (`files.write_laid_out`), the logs are linked without a shuffle. Do not store them
    as two and union these: a union of bucketed scans claims the buckets' layout but does not bring them together (Spark 4.1.2).
    """
    taken = {"login_id": login_key, **(take or {})}
    cut = clock.whole_seconds if truncate_seconds else F.col
    login_at = logins.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
        F.col(by),
        cut(time).alias("_at"),
        F.lit(1).alias("_is_login"),
        F.col(login_key).alias("_tie"),
        F.struct(*[F.col(old).alias(new) for new, old in taken.items()]).alias("_login"),
        F.lit(0).cast("long").alias("_alone"),
    )
    trade_at = trades.select(
        F.struct(*trades.columns).alias("_trade"),
        # Trades without a user have no login to find: each is a group of its own.
        F.when(F.col(by).isNull(), F.xxhash64(trade_key)).otherwise(F.lit(0).cast("long")).alias("_alone"),
        F.col(by),
        cut(time).alias("_at"),
        F.lit(0).alias("_is_login"),
    )
    return trade_at.unionByName(login_at, allowMissingColumns=True)


def link_timeline(both: DataFrame, by: str = "id", hot: DataFrame | None | bool = True) -> DataFrame:
    """The trades of a timeline with the columns taken from their logins."""
    both, points = with_lanes(both, [by], ["_at", "_is_login"], hot)
    group = F.col("_alone") if points is None else F.when(F.col(by).isNull(), F.col("_alone")).otherwise(F.col(LANE))
    before = (
        Window.partitionBy(by, group)
        .orderBy("_at", "_is_login", F.desc("_tie"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    linked = both.withColumn("_last", F.last("_login", ignorenulls=True).over(before)).where("_is_login = 0")
    found = F.col("_last")
    if points is not None:
        backwards = F.when(F.col("_is_login") == 1, F.struct(-clock.instant_us("_at"), F.col("_tie")))
        ends = only_hot(both, [by], points).groupBy(by, LANE).agg(F.min_by("_login", backwards).alias("_end"))
        earlier = Window.partitionBy(by).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(by, LANE, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        linked = linked.join(F.broadcast(ends), [by, LANE], "left")
        found = F.coalesce("_last", "_carry")
    return linked.select("_trade.*", *[found[new].alias(new) for new in both.schema["_login"].dataType.names])


def attach_login(
    trades: DataFrame, logins: DataFrame, take: dict[str, str], login_id: str = "login_id", login_key: str = "log_id"
) -> DataFrame:
    """Add columns of the linked login to trades that have one; the others go."""
    side = logins.select(F.col(login_key).alias(login_id), *[F.col(old).alias(new) for new, old in take.items()])
    return attach(trades, side, [login_id])


def complete_left(keys: DataFrame, values: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """Every key, with its value where there is one and the filler where not."""
    return keys.join(values, key, "left").na.fill(fill)


def join_suffixed(
    left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner"
) -> DataFrame:
    """Equi-join that tells same-named columns apart by suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in shared})

    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), on, how)


def present_in(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key also occurs in the other table."""
    return attach(rows, other.select(*on).distinct(), on, "left_semi")


def side_by_side(left: DataFrame, right: DataFrame, key: str, how: str = "full") -> DataFrame:
    """Columns of two tables with one row per key next to each other."""
    return left.join(right, key, how)


def coverage(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """Per pair of tables: how many distinct keys the first has, and how many the second knows."""
    parts = []
    for name, (table, other) in pairs.items():
        known = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(1))
        ids = table.select(key).where(F.col(key).isNotNull()).distinct()
        parts.append(
            ids.join(known, key, "left").agg(
                F.lit(name).alias("pair"), F.count(F.lit(1)).alias("ids"), F.count("_known").alias("ids_in_other")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
