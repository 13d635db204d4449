"""Features of single trades, from the trade log and the linked logins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clock
from riskloom.operators.aggregates import usage_share
from riskloom.operators.hotkeys import attach, hot_keys, with_group_values
from riskloom.operators.joins import attach_login, link_asof
from riskloom.operators.ordered import with_gap, with_gap_parts
from riskloom.plans.login_facts import LoginFacts
from riskloom.session import freeze

# Login columns the trade features read, as they are called on a linked trade.
LINK_COLUMNS = {"login_time": "time", "login_device": "device", "login_city": "city"}
SHARES = ["device", "city"]
GAP_DAY = "trade_time_sub_day"


def hot_users(logins: DataFrame, trades: DataFrame) -> DataFrame | None:
    """Users with too many rows in both logs together: found once, used by all steps on either log."""
    return hot_keys(logins.select("id").unionByName(trades.select("id")), ["id"])


def linked_trades(
    trades: DataFrame, logins: DataFrame, truncate_seconds: bool = False, hot: DataFrame | None | bool = True
) -> DataFrame:
    """Trades with their link and the login columns the features need, written once."""
    return freeze(link_asof(trades, logins, LINK_COLUMNS, truncate_seconds=truncate_seconds, hot=hot), "linked")


def with_login_columns(trades: DataFrame, logins: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Linked trades with the login's columns; fetched through `login_id` unless the link brought them."""
    columns = columns or LINK_COLUMNS
    missing = {new: old for new, old in columns.items() if new not in trades.columns}
    if missing:
        return attach_login(trades, logins, missing)
    return trades.where(F.col("login_id").isNotNull())


def trade_login_gap(trades: DataFrame) -> DataFrame:
    """Add `st`: seconds of the day between the linked login and the trade."""
    return trades.withColumn("st", clock.gap_seconds(clock.gap_us("login_time", "time")))


def with_gap_statistics(trades: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Add the gap to the previous trade in days, and the user's statistics of it."""
    if hot is True:
        hot = hot_keys(trades, ["id"])
    out = with_gap(trades, ["id"], "time", "rowkey", "_gap", hot)
    out = out.withColumn(GAP_DAY, clock.gap_days("_gap")).drop("_gap")
    if hot is not None:
        # The statistics are then grouped and attached: a second reader of the gaps.
        out = freeze(out, "gaps")
    statistics = {
        f"{GAP_DAY}_max": F.max(GAP_DAY),
        f"{GAP_DAY}_Mean": F.avg(GAP_DAY),
        f"{GAP_DAY}_min": F.min(GAP_DAY),
        f"{GAP_DAY}_std": F.stddev_samp(GAP_DAY),
        f"{GAP_DAY}_var": F.var_samp(GAP_DAY),
    }
    return with_group_values(out, ["id"], statistics, hot)


def with_usage_share(
    trades: DataFrame,
    logins: DataFrame,
    column: str,
    hot_pairs: DataFrame | None | bool = True,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Add how usual the linked login's value of `column` is for this user.

    Trades whose login has no value there go. `hot_pairs` are the trades' hot pairs of
    user and value, `hot` the hot users.
    """
    share = usage_share(logins, column, hot=hot).withColumnRenamed(column, f"login_{column}")
    return attach(trades, share, ["id", f"login_{column}"], "inner", hot_pairs)


def with_hour_deviation(trades: DataFrame) -> DataFrame:
    """Add the distance of the login's hour from the user's mean hour, in `l_time_mean`."""
    return trades.withColumn("sub_l_time_mean", F.abs(F.hour("login_time") - F.col("l_time_mean")))


def trade_features(
    trades: DataFrame,
    logins: DataFrame,
    version: str = "v3",
    facts: LoginFacts | None = None,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Trade features V1 or V3 for linked trades; unlinked ones go.

    `trades` carries `login_id`, from `linked_trades` or from a stored table. `facts` of the logins may be given; if
    they hold user features, these come along, and users without them lose their trades. What is known per user is joined while
    the trades are laid out by user for the gaps; a share is the user's rows with the login's value out of all with one.
    """
    if hot is True:
        hot = hot_users(logins, trades)
    facts = facts or LoginFacts(logins, SHARES, hours=version == "v3")
    out = trade_login_gap(with_login_columns(trades, logins))
    out = out.withColumn("hours", F.hour("time"))
    out = with_gap_statistics(out, hot)
    out = attach(out, facts.users(), ["id"], "inner", hot)
    if version == "v3":
        out = with_hour_deviation(out).drop("l_time_mean")
    for column in SHARES:
        # A user and a value can be hot only where the user is.
        pair = None if hot is None else hot_keys(trades_with(trades, out, column), ["id", f"login_{column}"])
        out = attach(out, facts.counts(column).withColumnRenamed(column, f"login_{column}"), ["id", f"login_{column}"], "inner", pair)
        out = out.withColumn(f"{column}_scale", F.col("_n") / F.col(f"{column}_all")).drop("_n", f"{column}_all")
    return out.drop("login_id", *LINK_COLUMNS)


def trades_with(trades: DataFrame, enriched: DataFrame, column: str) -> DataFrame:
    """The cheaper of the two tables that has the linked login's column."""
    return trades if f"login_{column}" in trades.columns else enriched


def trade_gaps_v2(trades: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Trades with the seconds part of the gap to the user's previous trade."""
    return with_gap_parts(trades, ["id"], "time", "rowkey", seconds="trade_diff_time", hot=hot)
