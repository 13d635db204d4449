"""Scalar functions."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import MODULUS, linked, logins, query, rounded, sql, trades
from riskloom.functions import clock, scalars
from riskloom.operators.ordered import with_gap
from riskloom.plans.trade_features import trade_login_gap


@query(
    "d1_hour_of_text",
    sql("SELECT rowkey, CAST(hour(trade_time) AS INT) AS hours FROM trade", "trade"),
)
def d1(spark, d):
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return trades(spark, d).select("rowkey", clock.hour_of_text(text).alias("hours"))


@query(
    "d2_first_19",
    sql("SELECT rowkey, substring(strftime(trade_time, '%Y-%m-%d %H:%M:%S.%f'), 1, 19) AS cut FROM trade", "trade"),
)
def d2(spark, d):
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return trades(spark, d).select("rowkey", clock.to_seconds_text(text).alias("cut"))


@query("d3_parse", sql("SELECT rowkey, trade_time AS tx FROM trade", "trade"))
def d3(spark, d):
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return trades(spark, d).select("rowkey", clock.parse(text).alias("tx"))


@query("d4_parse_pattern", sql("SELECT log_id, date_trunc('second', login_time) AS tx FROM login", "login"))
def d4(spark, d):
    unpadded = F.date_format("time", "yyyy-M-d H:mm:ss")
    return logins(spark, d).select("log_id", clock.parse(unpadded, "yyyy-M-d H:mm:ss").alias("tx"))


@query("d5_date", sql('SELECT log_id, CAST(login_time AS DATE) AS "date" FROM login', "login"))
def d5(spark, d):
    return logins(spark, d).select("log_id", F.to_date("time").alias("date"))


@query("d6_hour", sql('SELECT log_id, CAST(hour(login_time) AS INT) AS "hour" FROM login', "login"))
def d6(spark, d):
    return logins(spark, d).select("log_id", F.hour("time").alias("hour"))


_BACK = """CAST({} AS BIGINT) AS {} FROM (SELECT log_id, date_diff('microsecond', login_time,
  TIMESTAMP '2024-01-15 12:00:00') AS us FROM login)"""


def _to_noon(spark, d):
    # Half of these gaps run backwards.
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return logins(spark, d).select("log_id", clock.gap_us("time", noon).alias("us"))


@query("d7_gap_days", sql("SELECT log_id, " + _BACK.format("floor(us / 86400000000.0)", "days"), "login"))
def d7(spark, d):
    return _to_noon(spark, d).select("log_id", clock.gap_days("us").alias("days"))


@query(
    "d8_gap_seconds",
    sql("SELECT log_id, " + _BACK.format("((floor(us / 1000000.0) % 86400) + 86400) % 86400", "seconds"), "login"),
)
def d8(spark, d):
    return _to_noon(spark, d).select("log_id", clock.gap_seconds("us").alias("seconds"))


@query(
    "d9_trade_login_gap",
    sql(
        """SELECT rowkey, CAST(floor(date_diff('microsecond', login_time, trade_time) / 1000000.0) AS BIGINT) % 86400 AS st
        FROM linked WHERE login_id IS NOT NULL""",
        "linked",
    ),
)
def d9(spark, d):
    return trade_login_gap(linked(spark, d).where("login_id is not null")).select("rowkey", "st")


@query("d10_modulo", sql("SELECT log_id, timelong % 10 = 0 AS whole FROM login", "login"))
def d10(spark, d):
    return logins(spark, d).select("log_id", scalars.is_multiple("timelong", MODULUS).alias("whole"))


@query("d11_abs", sql("SELECT log_id, abs(timelong - 5000) AS off, round(abs(timelong / 7.0 - 700), 6) AS far FROM login", "login"))
def d11(spark, d):
    return rounded(
        logins(spark, d).select(
            "log_id",
            F.abs(F.col("timelong") - 5000).alias("off"),
            F.abs(F.col("timelong") / 7.0 - 700).alias("far"),
        )
    )


@query(
    "d12_time_before",
    sql("SELECT log_id FROM login WHERE strftime(login_time, '%Y-%m-%d %H:%M:%S') < '2024-01-10 08:30:00'", "login"),
)
def d12(spark, d):
    cut = F.lit("2024-01-10 08:30:00").cast("timestamp_ntz")
    return logins(spark, d).where(F.col("time") < cut).select("log_id")


@query(
    "d12_gap_microseconds",
    sql(
        """SELECT log_id, date_diff('microsecond', lag(login_time) OVER (PARTITION BY id ORDER BY login_time, log_id),
          login_time) AS gap FROM login""",
        "login",
    ),
)
def d12_gap(spark, d):
    return with_gap(logins(spark, d), ["id"], "time", "log_id", "gap").select("log_id", "gap")
