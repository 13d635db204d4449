"""Projections, filters, sorting and set operations."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.catalog.registry import linked, logins, query, sql, table, trades
from riskloom.functions import scalars
from riskloom.model.estimators import vector_stages
from riskloom.model.sampling import random_labels, smallest_draws
from riskloom.operators import explore, shaping
from riskloom.operators.joins import present_in, side_by_side
from riskloom.sources.fixtures import test_part, train_part


@query("p1_column_subset", sql("SELECT id, city FROM login", "login"))
def p1(spark, d):
    return logins(spark, d).select("id", "city")


@query("p2_drop_column", sql("SELECT log_id, timelong, id, is_scan FROM login", "login"))
def p2(spark, d):
    unused = ["device", "log_from", "ip", "city", "result", "timestamp", "type", "time", "is_sec"]
    return shaping.drop_columns(logins(spark, d), *unused)


@query("p3_rename", sql("SELECT login_id AS log_id, rowkey FROM linked", "linked"))
def p3(spark, d):
    return linked(spark, d).withColumnRenamed("login_id", "log_id").select("log_id", "rowkey")


@query("p4_reorder", sql('SELECT rowkey, is_risk, trade_time AS "time", id FROM trade', "trade"))
def p4(spark, d):
    return shaping.to_front(trades(spark, d), "rowkey", "is_risk")


@query("p5_constant_column", sql("SELECT log_id, id, 0 AS risk FROM login", "login"))
def p5(spark, d):
    return shaping.insert_at(logins(spark, d).select("log_id", "id"), 2, "risk", F.lit(0))


@query(
    "p6_append_columns",
    sql(
        """SELECT log_id, CAST(NOT is_scan AS INT) AS scan_False, CAST(is_scan AS INT) AS scan_True, is_sec
        FROM login""",
        "login",
    ),
)
def p6(spark, d):
    base = logins(spark, d).select("log_id", "is_scan", "is_sec")
    return shaping.append_columns(base, scalars.dummies("is_scan", "scan", [False, True])).drop("is_scan")


@query(
    "p6_append_tables",
    sql(
        """SELECT id, coalesce(a.n, b.n) IS NOT NULL AS either, a.n AS logins, b.n AS trades
        FROM (SELECT id, count(*) AS n FROM login GROUP BY id) a
        FULL JOIN (SELECT id, count(*) AS n FROM trade GROUP BY id) b USING (id)""",
        "login",
        "trade",
    ),
)
def p6_tables(spark, d):
    a = logins(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("logins"))
    b = trades(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("trades"))
    return side_by_side(a, b, "id").withColumn("either", F.coalesce("logins", "trades").isNotNull())


@query("p7_fill_zero", sql("SELECT rowkey, coalesce(login_id, 0) AS login_id FROM linked", "linked"))
def p7(spark, d):
    return linked(spark, d).select("rowkey", "login_id").na.fill(0)


@query(
    "p8_cast_int",
    sql("SELECT rowkey, CAST(strftime(trade_time, '%H') AS INT) AS hours FROM trade", "trade"),
)
def p8(spark, d):
    return trades(spark, d).select("rowkey", F.date_format("time", "HH").try_cast("int").alias("hours"))


@query(
    "p9_dummies",
    sql(
        """SELECT log_id, CAST(log_from = 'click' AS INT) AS from_click, CAST(log_from = 'error' AS INT) AS from_error,
          CAST(log_from = 'view' AS INT) AS from_view FROM login""",
        "login",
    ),
)
def p9(spark, d):
    return logins(spark, d).select("log_id", *scalars.dummies("log_from", "from", ["click", "error", "view"]))


@query(
    "p10_feature_matrix",
    sql(
        """SELECT rowkey, CAST(is_risk AS DOUBLE) AS label, CAST(coalesce(login_device, -1) AS DOUBLE) AS x_device,
          CAST(coalesce(login_city, -1) AS DOUBLE) AS x_city, CAST(login_device IS NULL AS DOUBLE) AS no_device,
          CAST(login_city IS NULL AS DOUBLE) AS no_city FROM linked""",
        "linked",
    ),
)
def p10(spark, d):
    named = linked(spark, d).select("rowkey", "is_risk", "id", "login_device", "login_city")
    matrix = Pipeline(stages=vector_stages(named)).fit(named).transform(named)
    x = vector_to_array("features")
    names = ["x_device", "x_city", "no_device", "no_city"]
    return matrix.select(
        "rowkey", F.col("is_risk").cast("double").alias("label"), *[x[i].alias(n) for i, n in enumerate(names)]
    )


@query(
    "p11_random_labels",
    sql(
        """SELECT rowkey, CASE WHEN md5('27:' || rowkey) >= '8' THEN 1 ELSE 0 END AS r
        FROM trade WHERE rowkey % 5 = 0""",
        "trade",
    ),
)
def p11(spark, d):
    return random_labels(test_part(trades(spark, d), "rowkey"))


@query("p12_ratio", sql("SELECT log_id, round(timelong / (ip + 1.0), 6) AS ratio FROM login", "login"))
def p12(spark, d):
    return logins(spark, d).select("log_id", F.round(scalars.share("timelong", F.col("ip") + 1.0), 6).alias("ratio"))


@query("f1_not_equal_or_missing", sql("SELECT log_id, result FROM login WHERE result IS DISTINCT FROM 1", "login"))
def f1(spark, d):
    return logins(spark, d).where(scalars.differs("result", 1)).select("log_id", "result")


@query("f2_equal", sql("SELECT log_id, device, is_scan FROM login WHERE device = 3 AND NOT is_scan", "login"))
def f2(spark, d):
    return logins(spark, d).where(F.col("device") == 3).where(~F.col("is_scan")).select("log_id", "device", "is_scan")


@query(
    "f3_compound",
    sql("SELECT log_id, id FROM login WHERE id = 7 AND login_time < TIMESTAMP '2024-01-10 00:00:00'", "login"),
)
def f3(spark, d):
    before = F.col("time") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return logins(spark, d).where((F.col("id") == 7) & before).select("log_id", "id")


@query(
    "f4_member_of",
    sql(
        "SELECT rowkey, id FROM trade WHERE id IN (SELECT o_custkey FROM orders)",
        "trade",
    ),
)
def f4(spark, d):
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return present_in(trades(spark, d), buyers, ["id"]).select("rowkey", "id")


@query(
    "f5_threshold",
    sql("SELECT log_id, CASE WHEN timelong / 10000.0 >= 0.99 THEN 1 ELSE 0 END AS over FROM login", "login"),
)
def f5(spark, d):
    return logins(spark, d).select("log_id", scalars.at_least(F.col("timelong") / 10000.0, 0.99).alias("over"))


@query("o1_sort", sql('SELECT log_id, login_time AS "time" FROM login ORDER BY login_time DESC, log_id', "login"))
def o1(spark, d):
    return logins(spark, d).select("log_id", "time").orderBy(F.desc("time"), "log_id")


@query("o2_first_rows", sql("SELECT log_id, timelong FROM login ORDER BY timelong DESC, log_id LIMIT 5", "login"))
def o2(spark, d):
    return logins(spark, d).select("log_id", "timelong").orderBy(F.desc("timelong"), "log_id").limit(5)


@query(
    "o3_drill_down",
    sql('SELECT log_id, id, login_time AS "time" FROM login WHERE device = 3 ORDER BY login_time, log_id', "login"),
)
def o3(spark, d):
    return explore.drill_down(logins(spark, d), trades(spark, d), 3, user=None)[0].select("log_id", "id", "time")


@query(
    "o3_drill_down_user",
    sql(
        """SELECT 'login' AS kind, log_id AS key FROM login WHERE device = 3 AND id = 7
        UNION ALL SELECT 'trade', rowkey FROM trade WHERE id = 7""",
        "login",
        "trade",
    ),
)
def o3_user(spark, d):
    seen, theirs = explore.drill_down(logins(spark, d), trades(spark, d), 3, user=7)
    return shaping.union_all(
        seen.select(F.lit("login").alias("kind"), F.col("log_id").alias("key")),
        theirs.select(F.lit("trade").alias("kind"), F.col("rowkey").alias("key")),
    )


@query("u1_union_all", sql("SELECT log_id, id, timelong FROM login", "login"))
def u1(spark, d):
    login = logins(spark, d).select("log_id", "id", "timelong")
    return shaping.union_all(test_part(login, "log_id"), train_part(login, "log_id"))


@query(
    "u2_recombine",
    sql(
        """(SELECT rowkey, is_risk FROM trade WHERE is_risk = 1) UNION ALL
        (SELECT rowkey, is_risk FROM (SELECT rowkey, is_risk, row_number() OVER (ORDER BY md5('5:' || rowkey), rowkey) AS n
          FROM trade WHERE is_risk = 0) WHERE n <= (SELECT count(*) FROM trade WHERE is_risk = 1))""",
        "trade",
    ),
)
def u2(spark, d):
    trade = trades(spark, d).select("rowkey", "is_risk")
    risky = trade.where("is_risk = 1")
    return shaping.union_all(risky, smallest_draws(trade.where("is_risk = 0"), risky.count(), "rowkey", seed=5))
