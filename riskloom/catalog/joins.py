"""Joins."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import MODULUS, linked, logins, query, rounded, sql, table, trades
from riskloom.operators import joins
from riskloom.operators.hotkeys import attach, with_group_values
from riskloom.plans.trade_features import trade_features, with_login_columns
from riskloom.plans.user_features import user_features


@query(
    "j1_inner",
    sql(
        """SELECT rowkey, n FROM trade JOIN (SELECT id, count(*) AS n FROM login GROUP BY id)
        USING (id)""",
        "login",
        "trade",
    ),
)
def j1(spark, d):
    seen = logins(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return attach(trades(spark, d), seen, ["id"]).select("rowkey", "n")


@query(
    "j2_link_join",
    sql(
        """SELECT t.rowkey, t.login_id, l.login_time, l.ip AS login_ip
        FROM linked t JOIN login l ON t.login_id = l.log_id""",
        "linked",
        "login",
    ),
)
def j2(spark, d):
    stored = linked(spark, d).select("rowkey", "login_id")
    return joins.attach_login(stored, logins(spark, d), {"login_time": "time", "login_ip": "ip"})


@query(
    "j3_composite_key",
    sql(
        """SELECT log_id, n FROM login JOIN (SELECT id, city, count(*) AS n FROM login GROUP BY id, city)
        USING (id, city)""",
        "login",
    ),
)
def j3(spark, d):
    login = logins(spark, d)
    n = login.groupBy("id", "city").agg(F.count(F.lit(1)).alias("n"))
    return attach(login, n, ["id", "city"]).select("log_id", "n")


@query(
    "j4_complete",
    sql("SELECT rowkey, CASE WHEN login_city = 2 THEN 1 ELSE 0 END AS is_risk FROM linked", "linked"),
)
def j4(spark, d):
    trade = linked(spark, d)
    known = trade.where("login_id is not null").select(
        "rowkey", (F.col("login_city") == 2).cast("int").alias("is_risk")
    )
    return joins.complete_left(trade.select("rowkey"), known, "rowkey", {"is_risk": 0})


@query(
    "j5_suffixes",
    sql(
        """SELECT id, a.n AS n_x, a.last AS last_x, b.n AS n_y, b.last AS last_y
        FROM (SELECT o_custkey AS id, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) a
        JOIN (SELECT id, count(*) AS n, max(trade_time) AS last FROM trade GROUP BY 1) b USING (id)""",
        "trade",
    ),
)
def j5(spark, d):
    def per_user(rows, time):
        return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))

    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return joins.join_suffixed(per_user(orders, "o_orderdate"), per_user(trades(spark, d), "time"), ["id"])


@query(
    "j6_full_outer",
    sql(
        """SELECT id, a.orders, b.risks FROM (SELECT o_custkey AS id, count(*) AS orders FROM orders GROUP BY 1) a
        FULL JOIN (SELECT id, sum(is_risk)::BIGINT AS risks FROM trade GROUP BY id) b USING (id)""",
        "trade",
    ),
)
def j6(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    b = trades(spark, d).groupBy("id").agg(F.sum("is_risk").alias("risks"))
    return joins.side_by_side(a, b, "id")


@query(
    "j7_semi",
    sql("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')"),
)
def j7(spark, d):
    buyers = trades(spark, d).select(F.col("id").alias("o_custkey"))
    return joins.present_in(table(spark, d, "orders"), buyers, ["o_custkey"]).select("o_orderkey")


@query("j8_asof", sql("SELECT rowkey, id, login_id, login_time FROM linked", "linked"))
def j8(spark, d):
    out = joins.link_asof(trades(spark, d), logins(spark, d), {"login_time": "time"})
    return out.select("rowkey", "id", "login_id", "login_time")


@query(
    "j8_asof_whole_seconds",
    sql(
        """, firsts AS (SELECT id, date_trunc('second', login_time) AS at, min(log_id) AS log_id FROM login GROUP BY 1, 2)
        SELECT rowkey, log_id AS login_id FROM (SELECT *, date_trunc('second', trade_time) AS cut FROM trade) t
        ASOF LEFT JOIN firsts f ON t.id = f.id AND t.cut > f.at""",
        "login",
        "trade",
    ),
)
def j8_seconds(spark, d):
    return joins.link_asof(trades(spark, d), logins(spark, d), truncate_seconds=True).select("rowkey", "login_id")


@query(
    "j8_asof_day_ties",
    """SELECT o_orderkey AS rowkey, log_id AS login_id FROM orders o
      ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS log_id FROM orders WHERE o_orderstatus = 'F'
        GROUP BY 1, 2) f ON o.o_custkey = f.o_custkey AND o.o_orderdate > f.o_orderdate""",
)
def j8_ties(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("rowkey"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("time"),
        "o_orderstatus",
    )
    closed = orders.where("o_orderstatus = 'F'").withColumnRenamed("rowkey", "log_id")
    return joins.link_asof(orders, closed).select("rowkey", "login_id")


@query(
    "j9_aggregate_back",
    sql(
        """SELECT log_id, max(timelong) OVER (PARTITION BY id) AS timelong_max,
          round(avg(timelong) OVER (PARTITION BY id), 6) AS timelong_Mean FROM login""",
        "login",
    ),
)
def j9(spark, d):
    values = {"timelong_max": F.max("timelong"), "timelong_Mean": F.avg("timelong")}
    login = with_group_values(logins(spark, d), ["id"], values)
    return login.select("log_id", "timelong_max", F.round("timelong_Mean", 6).alias("timelong_Mean"))


@query(
    "j10_fan_in",
    sql("SELECT * EXCLUDE (trade_time) FROM users_v3 JOIN trade_v1 USING (id)", "users_v3", "trade_v1"),
)
def j10(spark, d):
    login = logins(spark, d)
    users = user_features(login, "v3", MODULUS)
    return rounded(attach(trade_features(linked(spark, d), login, "v1"), users, ["id"]).drop("time"))


@query(
    "j2_login_columns",
    sql(
        """SELECT t.rowkey, l.login_time, l.device AS login_device, l.city AS login_city
        FROM linked t JOIN login l ON t.login_id = l.log_id""",
        "linked",
        "login",
    ),
)
def j2_columns(spark, d):
    out = with_login_columns(linked(spark, d).select("rowkey", "login_id"), logins(spark, d))
    return out.drop("login_id")
