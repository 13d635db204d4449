import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates, explore, hotkeys, joins, ordered, shaping
from riskloom.plans import user_features
from riskloom.plans.trade_features import with_gap_statistics, with_usage_share

LOGIN = "log_id int, id string, time timestamp_ntz, device int"
TRADE = "rowkey int, id string, time timestamp_ntz"
DAY = datetime(2017, 9, 10)


def at(text):
    return datetime.strptime(f"2017-09-10 {text}", "%Y-%m-%d %H:%M")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- the same random logs for all paths: one user holds half the rows, times repeat


def _logs(spark, n=400, seed=7):
    r = random.Random(seed)

    def user():
        return None if r.random() < 0.05 else "hot" if r.random() < 0.5 else f"u{r.randint(1, 9)}"

    def when():
        return None if r.random() < 0.02 else DAY + timedelta(minutes=r.randint(0, 90))

    logins = [(i, user(), when(), r.choice([1, 2, 3, None])) for i in range(n)]
    trades = [(i, user(), when()) for i in range(n // 2)]
    return logins, trades, spark.createDataFrame(logins, LOGIN), spark.createDataFrame(trades, TRADE)


def _brute_link(logins, trades):
    out = []
    for key, user, time in trades:
        before = [l for l in logins if user is not None and l[1] == user and time and l[2] and l[2] < time]
        best = min(before, key=lambda l: (-l[2].timestamp(), l[0]), default=None)
        out.append((key, best and best[0], best and best[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", ["small_hot", "no_hot"])
def test_link_against_brute_force(spark, request, hot):
    request.getfixturevalue(hot)
    logins, trades, login, trade = _logs(spark)
    out = joins.link_asof(trade, login, {"device": "device"})
    assert rows(out.select("rowkey", "login_id", "device")) == _brute_link(logins, trades)


@pytest.mark.parametrize("hot", ["small_hot", "no_hot"])
def test_previous_and_running_total_against_brute_force(spark, request, hot):
    request.getfixturevalue(hot)
    logins, _, login, _ = _logs(spark)
    kept = [l for l in logins if l[1] is not None]
    want_before, want_total = [], []
    for user in {l[1] for l in kept}:
        mine = sorted((l for l in kept if l[1] == user), key=lambda l: (l[2] or datetime.min, l[0]))
        total = None
        for i, l in enumerate(mine):
            want_before.append((l[0], mine[i - 1][3] if i else None, mine[i - 1][0] if i else None))
            if l[3] is not None:
                total = (total or 0) + l[3]
            want_total.append((l[0], total))
    order = ["time", "log_id"]
    before = ordered.with_previous(login, ["id"], order, {"d": "device", "k": "log_id"})
    assert rows(before.select("log_id", "d", "k")) == sorted(want_before, key=repr)
    total = ordered.running_total(login, ["id"], order, {"t": "device"})
    assert rows(total.select("log_id", "t")) == sorted(want_total, key=repr)


@pytest.mark.parametrize("hot", ["small_hot", "no_hot"])
def test_whole_table_order(spark, request, hot):
    request.getfixturevalue(hot)
    df = spark.createDataFrame([(i, (i * 7) % 11) for i in range(60)], "k int, v int")
    total = rows(ordered.running_total(df, [], ["k"], {"t": "v"}).select("k", "t"))
    values = [(i * 7) % 11 for i in range(60)]
    assert total == sorted(((i, sum(values[: i + 1])) for i in range(60)), key=repr)
    diff = rows(ordered.difference(df, [], ["k"], ["v"]).select("k", "v_diff"))
    assert diff == sorted(((i, values[i] - values[i - 1] if i else None) for i in range(60)), key=repr)


def test_hot_keys_are_cut_and_bounded(spark, small_hot):
    _, _, login, _ = _logs(spark)
    hot = hotkeys.hot_keys(login, ["id"])
    found = {r["id"]: r["_copies"] for r in hot.collect()}
    assert list(found) == ["hot"] and found["hot"] >= 3
    laned, points = hotkeys.with_lanes(login, ["id"], ["time", "log_id"], hot)
    lanes = laned.where("id = 'hot'").groupBy("_lane").count().collect()
    assert len(lanes) == found["hot"]
    assert laned.where("id <> 'hot' or id is null").select("_lane").distinct().collect() == [(0,)]
    assert laned.count() == login.count() and "_lane" in laned.columns and points is not None


def test_ties_stay_in_one_lane(spark, small_hot):
    df = spark.createDataFrame([("a", DAY + timedelta(days=i // 40), i) for i in range(400)], "id string, time timestamp_ntz, k int")
    laned, _ = hotkeys.with_lanes(df, ["id"], ["time"])
    per_time = laned.groupBy("time").agg(F.count_distinct("_lane").alias("n"))
    assert per_time.where("n > 1").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_equals_join(spark, small_hot, how):
    _, _, login, _ = _logs(spark)
    per_key = spark.createDataFrame([("hot", 1), ("u1", 2), ("u3", 3), ("zz", 4)], "id string, n int")
    assert rows(hotkeys.attach(login, per_key, ["id"], how)) == rows(login.join(per_key, "id", how))
    pairs = spark.createDataFrame([("hot", 1, 5), ("hot", 2, 6), ("u1", 1, 7)], "id string, device int, n int")
    got = hotkeys.attach(login, pairs, ["id", "device"], how)
    assert rows(got) == rows(login.join(pairs, ["id", "device"], how))


def test_hot_path_broadcasts_only_bounded_tables(spark, small_hot):
    _, _, login, _ = _logs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        values = hotkeys.with_group_values(login, ["id"], {"n": F.count("device")})
        plan = values._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["std", "mad"])
def test_hot_and_ordinary_aggregates_agree(spark, name):
    _, _, login, _ = _logs(spark)
    got = []
    for least in ("5", str(10**12)):
        spark.conf.set(hotkeys.HOT_ROWS_CONF, least)
        out = aggregates.aggregate(login, "device", name)
        got.append(rows(out.select("id", F.round(f"device_{name}", 9))))
    spark.conf.unset(hotkeys.HOT_ROWS_CONF)
    assert got[0] == got[1]


# -- worked examples


def test_link_examples(spark):
    login = spark.createDataFrame(
        [(2, "a", at("10:00"), 1), (1, "a", at("10:00"), 2), (3, "a", at("10:05"), 3), (9, None, at("09:00"), 4)], LOGIN
    )
    trade = spark.createDataFrame(
        [(1, "a", at("10:05")), (2, "a", at("09:59")), (3, "a", at("10:06")), (4, None, at("11:00")), (5, "b", at("11:00"))],
        TRADE,
    )
    out = joins.link_asof(trade, login)
    assert out.columns == ["rowkey", "id", "time", "login_id"]
    assert rows(out.select("rowkey", "login_id")) == [(1, 1), (2, None), (3, 3), (4, None), (5, None)]


def test_link_cut_to_seconds(spark):
    login = spark.createDataFrame([(1, "a", at("10:00") + timedelta(milliseconds=200), 1)], LOGIN)
    trade = spark.createDataFrame([(1, "a", at("10:00") + timedelta(milliseconds=900))], TRADE)
    assert joins.link_asof(trade, login).first()["login_id"] == 1
    assert joins.link_asof(trade, login, truncate_seconds=True).first()["login_id"] is None


TIMES = ["2017-09-10 11:12:23", "2017-10-22 01:31:53", "2017-09-18 13:24:34", "2017-09-28 12:44:54", "2017-09-24 08:19:38"]


@pytest.mark.parametrize(
    "ids, days, seconds",
    [
        ("ABABA", [None, 23, 8, None, 5], [None, 46019, 7931, None, 68104]),
        ("42422", [None, 23, 8, 4, None], [None, 46019, 7931, 15916, None]),
    ],
)
def test_gap_examples(spark, ids, days, seconds):
    data = [(i, u, datetime.strptime(t, "%Y-%m-%d %H:%M:%S")) for i, (u, t) in enumerate(zip(ids, TIMES))]
    df = spark.createDataFrame(data, "k int, id string, time timestamp_ntz")
    out = ordered.with_gap_parts(df, ["id"], "time", "k", "d", "s")
    assert rows(out.select("k", "d", "s")) == sorted(zip(range(5), days, seconds), key=repr)


def test_running_total_example(spark):
    df = spark.createDataFrame(list(zip(range(5), [1, 3, 3, 2, 3], [2, 4, 7, 3, 7])), "k int, a int, b int")
    out = ordered.running_total(df, [], ["k"], {"A": "a", "B": "b"}).select("k", "A", "B")
    assert rows(out) == [(0, 1, 2), (1, 4, 6), (2, 7, 13), (3, 9, 16), (4, 12, 23)]


def test_group_sum_example(spark):
    df = spark.createDataFrame([("Li", 98.0), ("Li", 98.0), ("Li", 60.0), ("liu", 60.0), ("yu", 100.0)], "name string, score double")
    assert rows(aggregates.aggregate(df, "score", "sum", by="name")) == [("Li", 256.0), ("liu", 60.0), ("yu", 100.0)]


def test_mean_absolute_deviation_example(spark):
    data = [("a", 1), ("b", 1), ("b", 2), ("c", 3), ("c", 3), ("d", 1), ("d", 2), ("d", 4), ("d", 9), ("e", None), ("e", 1), ("e", 2), ("e", 5), (None, 8)]
    out = aggregates.aggregate(spark.createDataFrame(data, "id string, x int"), "x", ["mad", "count"])
    got = {r["id"]: (round(r["x_mad"], 7), r["x_count"]) for r in out.collect()}
    assert got == {"a": (0, 1), "b": (0.5, 2), "c": (0, 2), "d": (2.5, 4), "e": (1.5555556, 3)}


def test_failed_login_examples(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 31), ("c", None), ("d", 31), ("d", None), (None, 31)], "id string, result int")
    assert rows(aggregates.failed_login_counts(df)) == [("b", 1), ("c", 0), ("d", 1)]


def test_whole_second_example_and_forms_agree(spark):
    df = spark.createDataFrame([("a", 1000), ("a", 1500), ("a", None), ("b", 7), (None, 1000)], "id string, timelong long")
    assert rows(aggregates.whole_second_counts(df)) == [("a", 2, 1), ("b", 1, 0)]
    sums = aggregates.group(df.where("id is not null"), aggregates.whole_second_aggregates(), {})
    assert rows(sums) == [("a", 2, 1), ("b", 1, 0)]


@pytest.mark.parametrize("hot", ["small_hot", "no_hot"])
def test_usage_share_example(spark, request, hot):
    request.getfixturevalue(hot)
    login = spark.createDataFrame(
        [(1, "u", at("10:00"), 1), (2, "u", at("10:01"), 1), (3, "u", at("10:02"), 2), (4, "u", at("10:03"), None)], LOGIN
    )
    share = aggregates.usage_share(login, "device")
    assert [(r[0], r[1], round(r[2], 6)) for r in sorted(share.collect())] == [("u", 1, 0.666667), ("u", 2, 0.333333)]
    trade = spark.createDataFrame([(1, "u", 1), (2, "u", 2), (3, "u", None)], "rowkey int, id string, login_device int")
    out = with_usage_share(trade, login, "device")
    assert sorted(r["rowkey"] for r in out.collect()) == [1, 2]


def test_user_without_failed_login_goes_and_missing_statistics_are_zero(spark):
    data = [
        ("a", 1, 100, 1, 1, 1), ("a", 2, 200, 1, 1, 2), ("b", 3, 300, 31, 2, 2), ("c", 4, 400, None, 1, 1), (None, 5, 5, 31, 1, 1),
    ]
    df = spark.createDataFrame(data, "id string, log_id int, timelong long, result int, type int, city int")
    out = {r["id"]: r for r in user_features.user_features(df, "v3").collect()}
    assert sorted(out) == ["b", "c"]
    assert out["b"]["timelong_std"] == 0 and out["b"]["timelong_var"] == 0 and out["b"]["result_no1_Counts"] == 1
    assert out["c"]["result_no1_Counts"] == 0 and out["c"]["type_Counts"] == 1


@pytest.mark.parametrize("hot", ["small_hot", "no_hot"])
def test_gap_statistics_equal_group_and_join(spark, request, hot):
    request.getfixturevalue(hot)
    _, _, _, trade = _logs(spark, 300)
    trade = trade.where("time is not null")
    out = with_gap_statistics(trade)
    gaps = out.select("id", "rowkey", "trade_time_sub_day")
    back = gaps.join(gaps.groupBy("id").agg(F.max("trade_time_sub_day").alias("m"), F.avg("trade_time_sub_day").alias("a")), "id")
    assert rows(out.select("rowkey", "trade_time_sub_day_max", "trade_time_sub_day_Mean")) == rows(back.select("rowkey", "m", "a"))


def test_completion_example(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "rowkey int")
    known = spark.createDataFrame([(2, 1)], "rowkey int, is_risk int")
    assert rows(joins.complete_left(keys, known, "rowkey", {"is_risk": 0})) == [(1, 0), (2, 1), (3, 0)]


def test_row_of_max_takes_the_lowest_key_among_equals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, 1), ("b", 5, None)], "id string, k int, v int")
    assert rows(aggregates.row_of_max(df, ["id"], "v", "k", ["k", "v"])) == [("a", 2, 9), ("b", 4, 1)]
    assert rows(aggregates.row_of_max(df, [], "v", "k", ["id", "k"])) == [("a", 2)]


def test_exploration(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 3), (None, 4)], "a string, b int")
    assert [tuple(r) for r in explore.value_counts(df, "a").collect()] == [("x", 2), ("y", 1)]
    assert rows(explore.profile(df)) == [("a", "string", 3), ("b", "int", 3)]
    assert rows(explore.shape(df)) == [(4, 2)]
    assert rows(explore.distinct_counts(df, ["a", "b"])) == [(2, 3)]
    assert [r[0] for r in explore.distinct_values(df, "b", F.col("a") == "x", ascending=False).collect()] == [1, None]
    other = spark.createDataFrame([("x",), ("z",)], "a string")
    assert rows(joins.coverage({"p": (df, other)}, "a")) == [("p", 2, 1)]


def test_shaping(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert shaping.to_front(df, "c", "zz").columns == ["c", "a", "b"]
    assert shaping.insert_at(df, 1, "n", F.lit(0)).columns == ["a", "n", "b", "c"]
    assert shaping.insert_at(df, 2, "a").columns == ["b", "c", "a"]
    assert shaping.feature_columns(df, ("a",)) == ["b", "c"]
    both = joins.join_suffixed(df, df, ["a"])
    assert both.columns == ["a", "b_x", "c_x", "b_y", "c_y"]


def test_rows_without_user_belong_to_no_group(spark):
    df = spark.createDataFrame([(None, 1, 9.0), ("a", 2, 1.0), ("a", 3, float("nan"))], "id string, k long, v double")
    assert rows(aggregates.row_of_max(df, ["id"], "v", "k", ["k"])) == [("a", 3)]
    assert rows(aggregates.group(df, {"n": F.count("*")}, {})) == [("a", 2)]
    assert rows(aggregates.group(df, {"n": F.count("*")}, {"d": F.count_distinct("k")})) == [("a", 2, 2)]
    assert aggregates.row_of_max(df.where("false"), [], "v", "k", ["k"]).count() == 0
