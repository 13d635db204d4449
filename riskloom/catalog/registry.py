"""The list of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.trade_features import linked_trades
from riskloom.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULUS = 10  # "whole second" on the test data, whose durations are seldom multiples of 1000

# The logs as SQL; `login_time` and `trade_time` stand for the `time` of either log.
PARTS = {
    "login": """
      SELECT event_id AS log_id, CAST(round(value * 100) AS BIGINT) AS timelong,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS device, event_type AS log_from,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS ip,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 AS city,
        CASE WHEN event_type = 'error' THEN 31 ELSE 1 END AS result, epoch_us(ts) AS instant,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS type, user_id AS id,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0 AS is_scan,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 = 0 AS is_sec, ts AS login_time
      FROM events WHERE event_type <> 'purchase'""",
    "trade": """
      SELECT event_id AS rowkey, ts AS trade_time, user_id AS id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS is_risk
      FROM events WHERE event_type = 'purchase'""",
    "linked": """
      SELECT t.*, l.log_id AS login_id, l.login_time, l.device AS login_device, l.city AS login_city
      FROM trade t ASOF LEFT JOIN login l ON t.id = l.id AND t.trade_time > l.login_time""",
    "failed": "SELECT id, count(result) AS result_no1_Counts FROM login WHERE result IS DISTINCT FROM 1 GROUP BY id",
    "base_stats": """
      SELECT id, count(*) FILTER (WHERE timelong % 10 <> 0) AS whole_sec_false,
        count(*) FILTER (WHERE timelong % 10 = 0) AS whole_sec_true, min(timelong) AS timelong_min,
        max(timelong) AS timelong_max, CAST(sum(timelong) AS DOUBLE) / count(timelong) AS timelong_Mean,
        coalesce(v, 0) AS timelong_var, coalesce(sqrt(v), 0) AS timelong_std
      FROM (SELECT *, CAST(n * s2 - s1 * s1 AS DOUBLE) / nullif(n * (n - 1), 0) AS v FROM (SELECT *,
        count(timelong) OVER u AS n, sum(timelong) OVER u AS s1, sum(timelong * timelong) OVER u AS s2 FROM login
        WINDOW u AS (PARTITION BY id))) GROUP BY id, v""",
    "counted": """
      SELECT id, count(DISTINCT device) AS device_Counts, count(DISTINCT ip) AS ip_Counts,
        count(DISTINCT log_from) AS log_from_Counts, count(DISTINCT type) AS type_Counts,
        count(DISTINCT city) AS city_Counts, count(DISTINCT log_id) AS log_id_Counts
      FROM login GROUP BY id""",
    "users_v1": "SELECT * FROM base_stats JOIN counted USING (id) JOIN failed USING (id)",
    "users_v3": """
      SELECT base_stats.*, type_Counts, city_Counts, result_no1_Counts
      FROM base_stats JOIN counted USING (id) JOIN failed USING (id)""",
    "device_share": """
      SELECT id, device, n / sum(n) OVER (PARTITION BY id) AS device_scale
      FROM (SELECT id, device, CAST(count(log_id) AS DOUBLE) AS n FROM login WHERE device IS NOT NULL GROUP BY ALL)""",
    "city_share": """
      SELECT id, city, n / sum(n) OVER (PARTITION BY id) AS city_scale
      FROM (SELECT id, city, CAST(count(log_id) AS DOUBLE) AS n FROM login WHERE city IS NOT NULL GROUP BY ALL)""",
    "hours": """
      SELECT id, avg(h) AS l_time_mean, stddev_samp(h) AS l_time_std, var_samp(h) AS l_time_var
      FROM (SELECT DISTINCT id, CAST(login_time AS DATE) AS d, hour(login_time) AS h FROM login) GROUP BY id""",
    "trade_gap": """
      SELECT *, CAST(floor(date_diff('microsecond', lag(trade_time) OVER (PARTITION BY id ORDER BY trade_time, rowkey),
        trade_time) / 86400000000.0) AS BIGINT) AS gap_day
      FROM linked WHERE login_id IS NOT NULL""",
    "trade_v1": """
      SELECT g.rowkey, g.trade_time, g.is_risk, g.id,
        CAST(floor(date_diff('microsecond', g.login_time, g.trade_time) / 1000000.0) AS BIGINT) % 86400 AS st,
        CAST(hour(g.trade_time) AS INT) AS hours, g.gap_day AS trade_time_sub_day,
        max(gap_day) OVER w AS trade_time_sub_day_max, round(avg(gap_day) OVER w, 6) AS trade_time_sub_day_Mean,
        min(gap_day) OVER w AS trade_time_sub_day_min, round(stddev_samp(gap_day) OVER w, 6) AS trade_time_sub_day_std,
        round(var_samp(gap_day) OVER w, 6) AS trade_time_sub_day_var,
        round(device_scale, 6) AS device_scale, round(city_scale, 6) AS city_scale
      FROM trade_gap g JOIN device_share d ON g.id = d.id AND g.login_device = d.device
        JOIN city_share c ON g.id = c.id AND g.login_city = c.city
      WINDOW w AS (PARTITION BY g.id)""",
    "trade_v3": """
      SELECT trade_v1.*, round(abs(hour(l.login_time) - l_time_mean), 6) AS sub_l_time_mean
      FROM trade_v1 JOIN linked l USING (rowkey) JOIN hours ON hours.id = trade_v1.id""",
    "gaps_v2": """
      SELECT *, CAST(floor(us / 86400000000.0) AS BIGINT) AS login_diff_day,
        CAST(floor(us / 1000000.0) AS BIGINT) % 86400 AS login_diff_seconds
      FROM (SELECT *, date_diff('microsecond', lag(login_time) OVER (PARTITION BY id ORDER BY login_time, log_id),
        login_time) AS us FROM login)""",
    "users_v2": None,  # filled in below
    "trade_gap_v2": """
      SELECT *, CAST(floor(date_diff('microsecond', lag(trade_time) OVER (PARTITION BY id ORDER BY trade_time, rowkey),
        trade_time) / 1000000.0) AS BIGINT) % 86400 AS trade_diff_time
      FROM trade""",
}

_SIX = ("min", "max", "std", "var", "mean", "skew")


def sql_statistic(column: str, function: str) -> str:
    """A named aggregate of whole numbers in SQL: one formula on exact sums, with the group's count and sum on each row."""
    n, total = f"n_{column}", f"s_{column}"
    spread = f"CAST(count({column}) * sum({column} * {column}) - sum({column}) * sum({column}) AS DOUBLE)"
    var = f"{spread} / nullif(count({column}) * (count({column}) - 1), 0)"
    text = {
        "min": f"min({column})",
        "max": f"max({column})",
        "std": f"sqrt({var})",
        "var": var,
        "mean": f"CAST(sum({column}) AS DOUBLE) / nullif(count({column}), 0)",
        "skew": f"CASE WHEN count({column}) >= 3 THEN coalesce(skewness({column}), 0) END",
        "mad": f"CAST(sum(abs({n} * {column} - {total})) AS DOUBLE) / nullif(count({column}) * count({column}), 0)",
    }[function]
    name = f"{column}_{function}"
    return f"round({text}, 6) AS {name}" if function == "skew" else f"{text} AS {name}"


PARTS["users_v2"] = f"""
      SELECT id, {', '.join(f'count(DISTINCT {c}) AS {c}_nunique' for c in ('device', 'log_from', 'city', 'result', 'type'))},
        {', '.join(sql_statistic('timelong', f) for f in _SIX)},
        {', '.join(sql_statistic(c, f) for c in ('login_diff_day', 'login_diff_seconds') for f in (*_SIX, 'mad'))}
      FROM (SELECT *, {', '.join(f'count({c}) OVER u AS n_{c}, sum({c}) OVER u AS s_{c}' for c in ('login_diff_day', 'login_diff_seconds'))}
        FROM gaps_v2 WINDOW u AS (PARTITION BY id))
      GROUP BY id"""

_NEEDS = {
    "linked": ["login", "trade"],
    "failed": ["login"],
    "base_stats": ["login"],
    "counted": ["login"],
    "users_v1": ["base_stats", "counted", "failed"],
    "users_v3": ["base_stats", "counted", "failed"],
    "device_share": ["login"],
    "city_share": ["login"],
    "hours": ["login"],
    "trade_gap": ["linked"],
    "trade_v1": ["trade_gap", "device_share", "city_share"],
    "trade_v3": ["trade_v1", "hours"],
    "gaps_v2": ["login"],
    "users_v2": ["gaps_v2"],
    "trade_gap_v2": ["trade"],
}


def sql(body: str, *parts: str) -> str:
    """The query with the named parts, and what they need, in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for p in parts:
        need(p)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in order) + "\n" + body


def query(name: str, check: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if check is not None:
            ORACLE[name] = check
        return f

    return add


def is_exact(column: str) -> bool:
    """Statistics of whole numbers: one formula on exact sums, so two engines agree to the last bit."""
    return column.startswith(("timelong_", "login_diff_")) and not column.endswith("_skew")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles cut to what two engines agree on; exact ones as they are."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and not is_exact(c) else F.col(c) for c, t in df.dtypes])


logins = fixtures.logins
trades = fixtures.trades
table = fixtures.table


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked trades with the linked login's columns, stored."""
    return linked_trades(trades(spark, sf_dir), logins(spark, sf_dir))
