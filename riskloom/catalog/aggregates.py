"""Grouped aggregates."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import MODULUS, logins, query, rounded, sql, table, trades
from riskloom.operators import aggregates as agg
from riskloom.operators import explore, joins, sketches
from riskloom.session import freeze
from riskloom.sources.fixtures import test_part, train_part


@query("a1_distinct_users", sql("SELECT DISTINCT id FROM login WHERE id IS NOT NULL", "login"))
def a1(spark, d):
    return agg.distinct_keys(logins(spark, d))


@query("a2_distinct_counts", sql("SELECT id, ip_Counts, type_Counts, log_id_Counts FROM counted", "counted"))
def a2(spark, d):
    names = ["ip", "type", "log_id"]
    return agg.aggregate(logins(spark, d), names, "nunique").withColumnsRenamed({f"{c}_nunique": f"{c}_Counts" for c in names})


@query(
    "a2_sketched_counts",
    sql(
        """SELECT id, count(DISTINCT CAST(login_time AS DATE)) AS days, true AS ip_within, true AS log_id_within
        FROM login GROUP BY id""",
        "login",
    ),
)
def a2_sketched(spark, d):
    """Sketches per user and day, stored and merged; whether the estimates keep to their error bound of the exact counts."""
    login, names = logins(spark, d), ["ip", "log_id"]
    estimated = sketches.merged_counts(freeze(sketches.daily_sketches(login, names), "sketches"), names)
    exact = agg.aggregate(login, names, "nunique")
    bound = sketches.relative_error()
    within = {f"{c}_within": F.abs(F.col(f"{c}_Counts") - F.col(f"{c}_nunique")) <= F.ceil(F.col(f"{c}_nunique") * bound) for c in names}
    return estimated.join(exact, "id").select("id", "days", *[c.alias(n) for n, c in within.items()])


def _statistic(key: str, function: str, text: str):
    @query(key, sql(f"SELECT id, {text} AS timelong_{function} FROM login GROUP BY id", "login"))
    def one(spark, d):
        return rounded(agg.aggregate(logins(spark, d), "timelong", function))

    return one


_VARIANCE = """CAST(count(timelong) * sum(timelong * timelong) - sum(timelong) * sum(timelong) AS DOUBLE)
  / nullif(count(timelong) * (count(timelong) - 1), 0)"""
_statistic("a3_mean", "mean", "CAST(sum(timelong) AS DOUBLE) / count(timelong)")
_statistic("a4_min", "min", "min(timelong)")
_statistic("a5_max", "max", "max(timelong)")
_statistic("a6_variance", "var", _VARIANCE)
_statistic("a7_deviation", "std", f"sqrt({_VARIANCE})")
_statistic("a8_count", "count", "count(timelong)")
_statistic("a9_sum", "sum", "CAST(sum(timelong) AS BIGINT)")
_statistic("a10_adjusted_skew", "skew", "round(CASE WHEN count(timelong) >= 3 THEN coalesce(skewness(timelong), 0) END, 6)")


@query(
    "a11_mean_absolute_deviation",
    sql(
        """SELECT id, CAST(sum(abs(n * timelong - s)) AS DOUBLE) / (any_value(n) * any_value(n)) AS timelong_mad
        FROM (SELECT id, timelong, count(timelong) OVER u AS n, sum(timelong) OVER u AS s FROM login
          WINDOW u AS (PARTITION BY id)) GROUP BY id""",
        "login",
    ),
)
def a11(spark, d):
    return rounded(agg.aggregate(logins(spark, d), "timelong", "mad"))


@query(
    "a12_many_by_many",
    """SELECT l_orderkey, min(l_quantity) AS l_quantity_min, round(avg(l_quantity), 6) AS l_quantity_mean,
      count(DISTINCT l_quantity) AS l_quantity_nunique, min(l_extendedprice) AS l_extendedprice_min,
      round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
      count(DISTINCT l_extendedprice) AS l_extendedprice_nunique FROM lineitem GROUP BY l_orderkey""",
)
def a12(spark, d):
    columns = ["l_quantity", "l_extendedprice"]
    return rounded(agg.aggregate(table(spark, d, "lineitem"), columns, ["min", "mean", "nunique"], by="l_orderkey"))


@query("a13_whole_second_pivot", sql("SELECT id, whole_sec_false, whole_sec_true FROM base_stats", "base_stats"))
def a13(spark, d):
    return agg.whole_second_counts(logins(spark, d), "timelong", MODULUS)


@query(
    "a14_whole_second_sums",
    sql('SELECT id, whole_sec_false AS "timeScale_False", whole_sec_true AS "timeScale_True" FROM base_stats', "base_stats"),
)
def a14(spark, d):
    counts = agg.whole_second_aggregates("timelong", MODULUS, "timeScale", ("False", "True"))
    return agg.group(logins(spark, d), counts, {})


@query(
    "a15_failed_logins",
    sql("SELECT id, result_no1_Counts, timelong_max FROM failed JOIN base_stats USING (id)", "failed", "base_stats"),
)
def a15(spark, d):
    login = logins(spark, d)
    users = login.groupBy("id").agg(F.max("timelong").alias("timelong_max"))
    return agg.add_failed_logins(users, login)


@query("a16_value_counts", sql('SELECT ip, count(*) AS "count" FROM login GROUP BY ip', "login"))
def a16(spark, d):
    return explore.value_counts(logins(spark, d), "ip")


@query("a17_distinct_values", sql("SELECT count(DISTINCT id) AS id, count(DISTINCT ip) AS ip FROM login", "login"))
def a17(spark, d):
    return explore.distinct_counts(logins(spark, d), ["id", "ip"])


@query(
    "a18_usual_hour",
    sql(
        """SELECT id, round(l_time_mean, 6) AS l_time_mean, round(l_time_std, 6) AS l_time_std,
          round(l_time_var, 6) AS l_time_var FROM hours""",
        "hours",
    ),
)
def a18(spark, d):
    return rounded(agg.usual_hour(logins(spark, d)))


@query("a19_usage_share", sql("SELECT id, device, round(device_scale, 6) AS device_scale FROM device_share", "device_share"))
def a19(spark, d):
    return rounded(agg.usage_share(logins(spark, d), "device"))


@query(
    "a20_row_of_max",
    sql(
        """SELECT id, log_id, timelong FROM login
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY timelong DESC, log_id) = 1""",
        "login",
    ),
)
def a20(spark, d):
    return agg.row_of_max(logins(spark, d), ["id"], "timelong", "log_id", ["log_id", "timelong"])


@query(
    "a20_row_of_max_overall",
    sql("SELECT log_id, id, timelong FROM login ORDER BY timelong DESC, log_id LIMIT 1", "login"),
)
def a20_overall(spark, d):
    return agg.row_of_max(logins(spark, d), [], "timelong", "log_id", ["log_id", "id", "timelong"])


@query("a21_total", sql("SELECT CAST(sum(is_risk) AS BIGINT) AS total FROM trade", "trade"))
def a21(spark, d):
    return trades(spark, d).agg(F.sum("is_risk").alias("total"))


@query("a22_shape", sql('SELECT count(*) AS "rows", 13 AS "columns" FROM login', "login"))
def a22(spark, d):
    return explore.shape(logins(spark, d))


@query(
    "a23_profile",
    """SELECT * FROM (SELECT 'o_orderkey' AS "column", 'bigint' AS "type", count(o_orderkey) AS non_null FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders)""",
)
def a23(spark, d):
    return explore.profile(table(spark, d, "orders"))


@query(
    "a24_coverage",
    sql(
        """SELECT 'trade in login' AS pair, count(DISTINCT t.id) AS ids, count(DISTINCT l.id) AS ids_in_other
          FROM trade t LEFT JOIN (SELECT DISTINCT id FROM login) l ON t.id = l.id
        UNION ALL SELECT 'test in train', count(DISTINCT t.id), count(DISTINCT l.id)
          FROM (SELECT * FROM trade WHERE rowkey % 5 = 0) t
          LEFT JOIN (SELECT DISTINCT id FROM trade WHERE rowkey % 5 <> 0) l ON t.id = l.id
        UNION ALL SELECT 'customer in trade', count(DISTINCT t.c_custkey), count(DISTINCT l.id)
          FROM customer t LEFT JOIN (SELECT DISTINCT id FROM trade) l ON t.c_custkey = l.id""",
        "login",
        "trade",
    ),
)
def a24(spark, d):
    trade = trades(spark, d)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return joins.coverage(
        {
            "trade in login": (trade, logins(spark, d)),
            "test in train": (test_part(trade, "rowkey"), train_part(trade, "rowkey")),
            "customer in trade": (customers, trade),
        },
        "id",
    )


@query("a25_sorted_values", sql("SELECT DISTINCT log_from FROM login WHERE NOT is_scan ORDER BY 1", "login"))
def a25(spark, d):
    return explore.distinct_values(logins(spark, d), "log_from", ~F.col("is_scan"))
