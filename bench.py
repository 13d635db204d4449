"""Time the main queries; prints one JSON line.

All queries are run once to warm up and once for the clock, into a sink that discards
the rows. `alternatives` times the plainer form of the same work, for comparison:
one grouping per feature joined one by one, the link as a join on time, statistics
grouped and joined back.
"""

from __future__ import annotations

import functools
import json
import os
import re
import time

from pyspark.sql import functions as F

from riskloom.catalog import QUERIES
from riskloom.catalog.registry import MODULUS, logins, trades
from riskloom.operators.hotkeys import hot_keys
from riskloom.plans import tables
from riskloom.plans.user_features import COUNTED
from riskloom.session import local_session

HEADLINE = [
    "j8_asof",
    "j8_asof_whole_seconds",
    "e1_user_features_v1",
    "e2_user_features_v3",
    "e3_trade_features_v1",
    "e4_trade_features_v3",
    "e5_model_table_v1",
    "e5_model_table_v3",
    "e6_login_table_v2",
    "e7_model_table_v2",
    "w2_login_gap",
    "w6_running_total",
    "w7_gap_statistics",
    "w8_hour_deviation",
    "a11_mean_absolute_deviation",
    "a12_many_by_many",
    "a13_whole_second_pivot",
    "a18_usual_hour",
    "a19_usage_share",
    "m1_undersample",
]


def one_grouping_per_feature(spark, d):
    login = logins(spark, d)
    features = [F.count_if(F.col("timelong") % MODULUS == 0), F.count_if(F.col("timelong") % MODULUS != 0)]
    features += [f("timelong") for f in (F.min, F.max, F.avg, F.var_samp, F.stddev_samp)]
    features += [F.count_distinct(c) for c in COUNTED["v1"]]
    parts = [login.groupBy("id").agg(f.alias(f"f{i}")) for i, f in enumerate(features)]
    return functools.reduce(lambda a, b: a.join(b, "id"), parts)


def link_by_join_on_time(spark, d):
    trade = trades(spark, d).withColumnRenamed("time", "trade_time")
    login = logins(spark, d).select("id", "log_id", "time")
    both = trade.join(login, (trade["id"] == login["id"]) & (login["time"] < trade["trade_time"])).drop(login["id"])
    last = both.groupBy("rowkey").agg(F.max_by("log_id", "time").alias("login_id"))
    return trade.join(last, "rowkey", "left")


def statistics_joined_back(spark, d):
    gapped = tables.login_gaps(logins(spark, d), hot_keys(logins(spark, d), ["id"]))
    stats = gapped.groupBy("id").agg(F.max("login_diff_day").alias("m"), F.stddev_samp("login_diff_day").alias("s"))
    return gapped.select("log_id", "id", "login_diff_day").join(stats, "id")


ALTERNATIVES = {
    "e1_one_grouping_per_feature": one_grouping_per_feature,
    "j8_link_by_join_on_time": link_by_join_on_time,
    "w7_statistics_joined_back": statistics_joined_back,
}


def seconds(run, spark, folder: str) -> tuple[float, int]:
    """Time and number of shuffles."""
    start = time.perf_counter()
    df = run(spark, folder)
    df.write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    return round(spent, 3), len(re.findall(r"\bExchange ", plan))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    for _ in range(2):
        timed = {name: seconds(QUERIES[name], spark, folder) for name in HEADLINE}
        other = {name: seconds(run, spark, folder) for name, run in ALTERNATIVES.items()}
    print(
        json.dumps(
            {
                "metric": "total warm time of the main queries",
                "value": round(sum(t for t, _ in timed.values()), 3),
                "unit": "sec",
                "queries": {n: t for n, (t, _) in timed.items()},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "shuffles": {n: s for n, (_, s) in timed.items()},
                "alternatives": {n: t for n, (t, _) in other.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
