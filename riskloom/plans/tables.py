"""Model tables: one row per trade, keys in front, features behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.hotkeys import attach, hot_keys
from riskloom.operators.joins import link_asof
from riskloom.operators.shaping import to_front
from riskloom.plans.login_facts import LoginFacts
from riskloom.plans.trade_features import LINK_COLUMNS, SHARES, hot_users, linked_trades, trade_features, trade_gaps_v2
from riskloom.plans.user_features import login_gaps, user_features_v2
from riskloom.session import freeze

# Login columns that a V2 model row keeps.
V2_ROW = ["timelong", "is_scan", "is_sec", "login_diff_day", "login_diff_seconds"]
V2_DROPPED = ["device", "log_from", "ip", "city", "result", "timestamp", "type"]


def transfer_data(
    logins: DataFrame, trades: DataFrame, version: str = "v3", modulus: int = 1000, truncate_seconds: bool = False
) -> DataFrame:
    """Model table V1 or V3: user features and trade features of every linked trade.

    Trades without `login_id` are linked first, with `truncate_seconds` by their time cut to the second. With `is_risk` this is the training
    table, without it the table to score. The logins are read twice: for the link, and for all that is known per user
    (`LoginFacts`); the latter is written once.
    """
    hot = hot_users(logins, trades)
    if "login_id" not in trades.columns:
        # Read once, unless hot pairs are counted as well.
        if hot is None:
            trades = link_asof(trades, logins, LINK_COLUMNS, truncate_seconds=truncate_seconds, hot=None)
        else:
            trades = linked_trades(trades, logins, truncate_seconds, hot)
    facts = LoginFacts(logins, SHARES, version, modulus, hours=version == "v3")
    table = trade_features(trades, logins, version, facts, hot)
    return to_front(table.drop("time"), "rowkey", "is_risk", "id")


def login_table_v2(logins: DataFrame) -> DataFrame:
    """Every login with its gaps and its user's V2 features; raw code columns dropped.

    The gaps are written once and read for the features and for the rows.
    """
    hot = hot_keys(logins, ["id"])
    gapped = freeze(login_gaps(logins, hot), "gaps")
    users = user_features_v2(gapped, hot)
    return attach(gapped.drop(*V2_DROPPED), users, ["id"], "inner", hot)


def trade_table_v2(logins: DataFrame, trades: DataFrame) -> DataFrame:
    """Model table V2: linked trades with their gap, their login and their user's features.

    The user's features are joined to the trades rather than to every login: the rows
    are the same, and the login log is not widened.
    """
    hot = hot_users(logins, trades)
    gapped = freeze(login_gaps(logins, hot), "gaps")
    users = user_features_v2(gapped, hot)
    out = trade_gaps_v2(trades, hot)
    out = attach(out, users, ["id"], "inner", hot)
    # A login can be hot only where its user is.
    side = gapped.select(F.col("log_id").alias("login_id"), *V2_ROW)
    out = attach(out, side, ["login_id"], "inner", None if hot is None else hot_keys(trades, ["login_id"]))
    return to_front(out.drop("time", "login_id"), "rowkey", "is_risk", "id")
