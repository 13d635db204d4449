"""Ordered operators."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import linked, logins, query, rounded, sql, table, trades
from riskloom.operators import ordered
from riskloom.operators.aggregates import usual_hour
from riskloom.operators.hotkeys import attach
from riskloom.plans.trade_features import trade_gaps_v2, with_gap_statistics, with_hour_deviation
from riskloom.plans.user_features import login_gaps
from riskloom.session import freeze


@query(
    "w1_trade_gap",
    sql(
        """SELECT rowkey, date_diff('microsecond', lag(trade_time) OVER (PARTITION BY id ORDER BY trade_time, rowkey),
          trade_time) AS trade_time_sub FROM trade""",
        "trade",
    ),
)
def w1(spark, d):
    out = ordered.with_gap(trades(spark, d), ["id"], "time", "rowkey", "trade_time_sub")
    return out.select("rowkey", "trade_time_sub")


@query("w2_login_gap", sql("SELECT log_id, login_diff_day, login_diff_seconds FROM gaps_v2", "gaps_v2"))
def w2(spark, d):
    return login_gaps(logins(spark, d)).select("log_id", "login_diff_day", "login_diff_seconds")


@query("w3_trade_gap_seconds", sql("SELECT rowkey, trade_diff_time FROM trade_gap_v2", "trade_gap_v2"))
def w3(spark, d):
    return trade_gaps_v2(trades(spark, d)).select("rowkey", "trade_diff_time")


@query(
    "w4_grouped_difference",
    """SELECT o_orderkey, date_diff('microsecond', lag(o_orderdate) OVER w, o_orderdate) AS o_orderdate_diff,
      round(o_totalprice - lag(o_totalprice) OVER w, 6) AS o_totalprice_diff
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def w4(spark, d):
    out = ordered.difference(
        table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_totalprice"]
    )
    return rounded(out.select("o_orderkey", "o_orderdate_diff", "o_totalprice_diff"))


@query(
    "w5_difference_of_sums",
    sql(
        """SELECT id, CAST(ip - lag(ip) OVER w AS BIGINT) AS ip_diff, CAST(city - lag(city) OVER w AS BIGINT) AS city_diff,
          CAST(scan_True - lag(scan_True) OVER w AS BIGINT) AS scan_True_diff
        FROM (SELECT id, sum(ip) AS ip, sum(city) AS city, count(*) FILTER (WHERE is_scan) AS scan_True
          FROM login GROUP BY id) WINDOW w AS (ORDER BY id)""",
        "login",
    ),
)
def w5(spark, d):
    sums = logins(spark, d).groupBy("id").agg(
        F.sum("ip").alias("ip"), F.sum("city").alias("city"), F.count_if("is_scan").alias("scan_True")
    )
    out = ordered.difference(freeze(sums, "sums"), [], ["id"], ["ip", "city", "scan_True"])
    return out.select("id", "ip_diff", "city_diff", "scan_True_diff")


@query(
    "w6_running_total",
    sql(
        """SELECT log_id, CAST(sum(timelong) OVER (ORDER BY login_time, log_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
        FROM login""",
        "login",
    ),
)
def w6(spark, d):
    login = logins(spark, d).select("log_id", "time", "timelong")
    out = ordered.running_total(login, [], ["time", "log_id"], {"total": "timelong"})
    return out.select("log_id", "total")


@query(
    "w6_running_total_per_user",
    sql(
        """SELECT rowkey, CAST(sum(is_risk) OVER (PARTITION BY id ORDER BY trade_time, rowkey ROWS UNBOUNDED PRECEDING)
          AS BIGINT) AS risks FROM trade""",
        "trade",
    ),
)
def w6_user(spark, d):
    out = ordered.running_total(trades(spark, d), ["id"], ["time", "rowkey"], {"risks": "is_risk"})
    return out.select("rowkey", "risks")


@query(
    "w7_gap_statistics",
    sql(
        """SELECT rowkey, gap_day AS trade_time_sub_day, max(gap_day) OVER w AS trade_time_sub_day_max,
          round(avg(gap_day) OVER w, 6) AS trade_time_sub_day_Mean, min(gap_day) OVER w AS trade_time_sub_day_min,
          round(stddev_samp(gap_day) OVER w, 6) AS trade_time_sub_day_std,
          round(var_samp(gap_day) OVER w, 6) AS trade_time_sub_day_var
        FROM (SELECT rowkey, id, CAST(floor(date_diff('microsecond', lag(trade_time)
          OVER (PARTITION BY id ORDER BY trade_time, rowkey), trade_time) / 86400000000.0) AS BIGINT) AS gap_day
          FROM trade) WINDOW w AS (PARTITION BY id)""",
        "trade",
    ),
)
def w7(spark, d):
    return rounded(with_gap_statistics(trades(spark, d)).drop("id", "time", "is_risk"))


@query(
    "w8_hour_deviation",
    sql(
        """SELECT rowkey, round(abs(hour(login_time) - l_time_mean), 6) AS sub_l_time_mean
        FROM linked JOIN hours USING (id) WHERE login_id IS NOT NULL""",
        "linked",
        "hours",
    ),
)
def w8(spark, d):
    known = linked(spark, d).where("login_id is not null")
    out = with_hour_deviation(attach(known, usual_hour(logins(spark, d)), ["id"]))
    return rounded(out.select("rowkey", "sub_l_time_mean"))
