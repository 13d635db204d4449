import re

import pytest
from pyspark.sql import functions as F

from riskloom.catalog import QUERIES
from riskloom.operators import hotkeys
from riskloom.operators.hotkeys import HOT_ROWS_CONF
from riskloom.operators.joins import link_asof, link_timeline, timeline
from riskloom.operators.ordered import with_gap
from riskloom.plans import tables
from riskloom.plans.trade_features import linked_trades, with_gap_statistics
from riskloom.plans.user_features import user_features
from riskloom.sources import files, fixtures, schemas
from riskloom.session import scratch_path


def _rounded(df):
    kinds = dict(df.dtypes)
    columns = [F.round(c, 3).alias(c) if kinds[c] == "double" else F.col(c) for c in sorted(df.columns)]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _skewed(spark, sf):
    """The logs with a third of all rows given to one user."""
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    return (
        login.withColumn("id", F.when(F.col("log_id") % 3 == 0, 7).otherwise(F.col("id"))),
        trade.withColumn("id", F.when(F.col("rowkey") % 3 == 0, 7).otherwise(F.col("id"))),
    )


@pytest.mark.parametrize("make", ["v1", "v3", "logins", "v2"])
def test_tables_do_not_depend_on_hot_keys(spark, sf, make):
    login, trade = _skewed(spark, sf)
    got = []
    for least in ("20", str(10**12)):
        spark.conf.set(HOT_ROWS_CONF, least)
        if make == "logins":
            got.append(_rounded(tables.login_table_v2(login)))
        elif make == "v2":
            stored = linked_trades(trade, login).select(*trade.columns, "login_id")
            got.append(_rounded(tables.trade_table_v2(login, stored)))
        else:
            got.append(_rounded(tables.transfer_data(login, trade, make, 10)))
    spark.conf.unset(HOT_ROWS_CONF)
    assert got[0] and got[0] == got[1]


def test_stored_link_gives_the_same_table(spark, sf):
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    stored = linked_trades(trade, login).select(*trade.columns, "login_id")
    assert _rounded(tables.transfer_data(login, stored, "v3", 10)) == _rounded(tables.transfer_data(login, trade, "v3", 10))


def test_keys_come_first_and_label_is_optional(spark, sf):
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    assert tables.transfer_data(login, trade).columns[:3] == ["rowkey", "is_risk", "id"]
    assert tables.transfer_data(login, trade.drop("is_risk")).columns[:2] == ["rowkey", "id"]


def _shuffles(df):
    df.write.format("noop").mode("overwrite").save()
    return len(re.findall(r"\bExchange (?:hash|range|Single|Round)", df._jdf.queryExecution().executedPlan().toString()))


def test_number_of_shuffles(spark, sf, no_hot):
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _shuffles(link_asof(trade, login)) == 1
        assert _shuffles(with_gap(trade, ["id"], "time", "rowkey", "g")) == 1
        # The gap and its statistics share one layout.
        assert _shuffles(with_gap_statistics(trade)) == 1
        # One for the plain statistics, two for the counts of different values.
        assert _shuffles(user_features(login, "v1")) == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_means_several_tasks(spark):
    rows = spark.range(800).selectExpr("IF(id < 300, 7, id) AS id")
    spark.conf.set(HOT_ROWS_CONF, "5")
    try:
        assert [tuple(r) for r in hotkeys.hot_keys(rows, ["id"]).collect()] == [(7, 3, 300)]
        spark.conf.set(hotkeys.HOT_TASKS_CONF, "5")
        assert hotkeys.hot_keys(rows, ["id"]) is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.set(hotkeys.HOT_TASKS_CONF, "1")


def test_left_attach_keeps_rows_without_key(spark, small_hot):
    rows = spark.range(400).selectExpr("IF(id < 150, NULL, IF(id < 300, 7, id)) AS id", "id AS n")
    per_key = spark.createDataFrame([(7, "a"), (350, "b")], "id long, v string")
    got = hotkeys.attach(rows, per_key, ["id"], "left")
    assert got.count() == 400 and got.where("v = 'a'").count() == 150 and got.where("id is null and v is null").count() == 150


def test_scan_reads_only_needed_columns(spark, sf):
    plan = user_features(fixtures.logins(spark, sf), "v3")._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan and "IsNotNull(user_id)" in plan


def test_csv_round_trip_of_a_declared_log(spark):
    text = "7,2015-01-29 13:38:53.0,90,1,55\n8,2015-01-30 01:00:00.0,91,0,\n"
    path = scratch_path(spark, "trade-text")
    header = "rowkey,time,id,is_risk,login_id"
    lines = [tuple(line.split(",")) for line in text.splitlines()]
    files.write_csv(spark.createDataFrame(lines, header.split(",")), path)
    df = files.typed_trades(files.read_csv(spark, path, schemas.LINKED_TRADE))
    got = {r["rowkey"]: r for r in df.collect()}
    assert got["7"]["time"].hour == 13 and got["7"]["login_id"] == "55" and got["8"]["login_id"] is None
    assert dict(df.dtypes)["time"] == "timestamp_ntz" and got["8"]["is_risk"] == 0


def test_laid_out_logs_are_linked_where_they_lie(spark, sf, no_hot):
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    trade = trade.withColumn("id", F.when(F.col("rowkey") % 10 != 0, F.col("id")))
    due = _rounded(link_asof(trade, login, {"city": "city"}))
    assert any(r[0] is not None for r in due)
    for aqe in ("true", "false"):
        path = scratch_path(spark, "log")
        laid_out = files.write_laid_out(timeline(trade, login, {"city": "city"}), f"log_{path.rsplit('-', 1)[1]}", "id", ["_at"], 6, path)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            linked = link_timeline(laid_out)
            assert _shuffles(linked) == 0
            assert _shuffles(with_gap(laid_out.where("_is_login = 1"), ["id"], "_at", "_tie", "g")) == 0
            assert _rounded(linked) == due
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")


def test_model_table_reads_the_logins_twice(spark, sf, no_hot):
    """Once for the link, once for the facts; the rest are readings of the stored facts."""
    login, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for version in ("v1", "v3"):
            df = tables.transfer_data(login, trade, version)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall("events.parquet", plan)) == 2  # both logs for the link
            assert _shuffles(df) <= 7  # and one for the facts, written before
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fan_in_joins_user_features_onto_trade_features(spark, tmp_path):
    """Login features of V3 and trade features of V1 in one row per linked trade; trades of users without features go."""
    rows = [
        (1, 7, "click", 1.25, "a3", "2024-01-01 10:00:00"),
        (2, 7, "error", 2.5, "a3", "2024-01-01 11:00:00"),
        (3, 7, "purchase", 150.0, "a1", "2024-01-01 12:00:30"),
        (4, 8, "click", 1.0, "a2", "2024-01-01 10:00:00"),  # no unsuccessful login: no features
        (5, 8, "purchase", 50.0, "a1", "2024-01-01 12:00:00"),
        (6, 9, "purchase", 50.0, "a1", "2024-01-01 12:00:00"),  # no login
        (7, None, "purchase", 50.0, "a1", "2024-01-01 12:00:00"),
    ]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts string")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    (got,) = QUERIES["j10_fan_in"](spark, str(tmp_path)).collect()
    assert (got["rowkey"], got["id"], got["is_risk"], got["st"], got["hours"]) == (3, 7, 1, 3630, 12)
    assert (got["timelong_max"], got["type_Counts"], got["result_no1_Counts"], got["device_scale"]) == (250, 1, 1, 1.0)
    assert "time" not in got and "device_Counts" not in got
