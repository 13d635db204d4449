"""Feature tables."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.catalog.registry import (
    MODULUS,
    PARTS,
    linked,
    logins,
    query,
    rounded,
    sql,
    trades,
)
from riskloom.operators.shaping import union_all
from riskloom.plans import tables
from riskloom.plans.trade_features import trade_features
from riskloom.plans.user_features import user_features
from riskloom.sources.fixtures import test_part, train_part


@query("e1_user_features_v1", sql("SELECT * FROM users_v1", "users_v1"))
def e1(spark, d):
    return rounded(user_features(logins(spark, d), "v1", MODULUS))


@query("e2_user_features_v3", sql("SELECT * FROM users_v3", "users_v3"))
def e2(spark, d):
    return rounded(user_features(logins(spark, d), "v3", MODULUS))


@query("e3_trade_features_v1", sql('SELECT * RENAME (trade_time AS "time") FROM trade_v1', "trade_v1"))
def e3(spark, d):
    return rounded(trade_features(linked(spark, d), logins(spark, d), "v1"))


@query("e4_trade_features_v3", sql('SELECT * RENAME (trade_time AS "time") FROM trade_v3', "trade_v3"))
def e4(spark, d):
    return rounded(trade_features(linked(spark, d), logins(spark, d), "v3"))


@query(
    "e5_model_table_v1",
    sql("SELECT * EXCLUDE (trade_time) FROM users_v1 JOIN trade_v1 USING (id)", "users_v1", "trade_v1"),
)
def e5_v1(spark, d):
    return rounded(tables.transfer_data(logins(spark, d), trades(spark, d), "v1", MODULUS))


def model_table_v3(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both logs to the V3 model table."""
    return rounded(tables.transfer_data(logins(spark, d), trades(spark, d), "v3", MODULUS))


query(
    "e5_model_table_v3",
    sql("SELECT * EXCLUDE (trade_time) FROM users_v3 JOIN trade_v3 USING (id)", "users_v3", "trade_v3"),
)(model_table_v3)


@query(
    "e5_model_table_v3_whole_seconds",
    sql("SELECT * EXCLUDE (trade_time) FROM users_v3 JOIN trade_v3 USING (id)", "users_v3", "trade_v3").replace(
        PARTS["linked"],
        """
      SELECT t.* EXCLUDE (cut), l.log_id AS login_id, l.login_time, l.device AS login_device, l.city AS login_city
      FROM (SELECT *, date_trunc('second', trade_time) AS cut FROM trade) t ASOF LEFT JOIN
        (SELECT *, date_trunc('second', login_time) AS at FROM login
          QUALIFY row_number() OVER (PARTITION BY id, date_trunc('second', login_time) ORDER BY log_id) = 1) l
        ON t.id = l.id AND t.cut > l.at""",
    ),
)
def e5_v3_seconds(spark, d):
    """As the flagship, with the times cut to the second before they are linked."""
    return rounded(tables.transfer_data(logins(spark, d), trades(spark, d), "v3", MODULUS, truncate_seconds=True))


@query(
    "e6_login_table_v2",
    sql(
        """SELECT log_id, timelong, is_scan, is_sec, login_time AS "time", login_diff_day, login_diff_seconds, users_v2.*
        FROM gaps_v2 JOIN users_v2 USING (id)""",
        "gaps_v2",
        "users_v2",
    ),
)
def e6(spark, d):
    return rounded(tables.login_table_v2(logins(spark, d)))


@query(
    "e7_model_table_v2",
    sql(
        """SELECT t.rowkey, t.is_risk, g.trade_diff_time, l.timelong, l.is_scan, l.is_sec, l.login_diff_day,
          l.login_diff_seconds, users_v2.*
        FROM linked t JOIN trade_gap_v2 g USING (rowkey) JOIN gaps_v2 l ON t.login_id = l.log_id
          JOIN users_v2 ON users_v2.id = t.id""",
        "linked",
        "trade_gap_v2",
        "users_v2",
    ),
)
def e7(spark, d):
    stored = linked(spark, d).select("rowkey", "time", "id", "is_risk", "login_id")
    return rounded(tables.trade_table_v2(logins(spark, d), stored))


@query(
    "e8_test_table",
    sql(
        """SELECT * EXCLUDE (trade_time, is_risk) FROM users_v3 JOIN trade_v3 USING (id)""",
        "users_v3",
        "trade_v3",
    ).replace("WHERE event_type = 'purchase'", "WHERE event_type = 'purchase' AND event_id % 5 = 0"),
)
def e8(spark, d):
    login = logins(spark, d)
    both = union_all(test_part(login, "log_id"), train_part(login, "log_id"))
    test = test_part(trades(spark, d), "rowkey").drop("is_risk")
    return rounded(tables.transfer_data(both, test, "v3", MODULUS))
