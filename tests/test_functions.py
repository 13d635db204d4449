from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions import clock, scalars
from riskloom.functions.stats import BY_NAME


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "earlier, later, days, seconds",
    [
        ("2017-09-10 12:00:00", "2017-09-10 11:00:00", -1, 82800),
        ("2017-09-10 00:00:00", "2017-09-11 01:00:01.9", 1, 3601),
        ("2017-09-10 11:12:23", "2017-09-18 13:24:34", 8, 7931),
        ("2017-09-10 11:12:23", "2017-09-10 11:12:23", 0, 0),
        ("2017-09-10 11:12:23.5", "2017-09-10 11:12:23", -1, 86399),
    ],
)
def test_gap_parts(spark, earlier, later, days, seconds):
    us = clock.gap_us(ntz(earlier), ntz(later))
    assert one(spark, clock.gap_days(us)) == days
    assert one(spark, clock.gap_seconds(us)) == seconds


def test_gap_ignores_the_sessions_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 00:00:00' a, timestamp_ntz'2024-03-10 12:00:00' b")
        row = df.select(clock.gap_us("a", "b").alias("us"), clock.parse(F.lit("2024-3-10 2:30:00"), "y-M-d H:mm:ss").alias("t"))
        row = row.first()
        assert row["us"] == 12 * 3600 * 1_000_000
        assert row["t"] == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_text_times(spark):
    text = F.lit("2015-01-29 13:38:53.0")
    assert one(spark, clock.hour_of_text(text)) == 13
    assert one(spark, clock.hour_of_text(F.lit("2015-01-29"))) is None
    assert one(spark, clock.to_seconds_text(text)) == "2015-01-29 13:38:53"
    assert one(spark, clock.parse(text)) == datetime(2015, 1, 29, 13, 38, 53)
    assert one(spark, clock.parse(F.lit("no time"))) is None
    assert one(spark, clock.parse(F.lit("2017-9-8 1:02:03"), "yyyy-M-d H:mm:ss")) == datetime(2017, 9, 8, 1, 2, 3)
    assert one(spark, clock.parse(F.lit("no time"), "yyyy-M-d H:mm:ss")) is None
    assert one(spark, clock.whole_seconds(ntz("2017-09-10 11:12:23.987654"))) == datetime(2017, 9, 10, 11, 12, 23)


def test_missing_is_different_but_no_multiple(spark):
    df = spark.createDataFrame([(1,), (31,), (None,)], "v int")
    assert [r["d"] for r in df.select(scalars.differs("v", 1).alias("d")).collect()] == [False, True, True]
    df = spark.createDataFrame([(1000,), (1500,), (None,)], "v int")
    assert [r["d"] for r in df.select(scalars.is_multiple("v").alias("d")).collect()] == [True, False, False]


def test_dummies(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "s boolean")
    out = df.select(*scalars.dummies("s", "scan", [False, True]))
    assert out.columns == ["scan_False", "scan_True"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (1, 0), (0, 0)]


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(500)
    drawn = df.select("id", scalars.draw("id", 3).alias("d"))
    again = df.repartition(7).select("id", scalars.draw("id", 3).alias("d"))
    assert sorted(drawn.collect()) == sorted(again.collect())
    assert 0.4 < sum(r["d"] < scalars.DRAWS // 2 for r in drawn.collect()) / 500 < 0.6


@pytest.mark.parametrize(
    "values, std, var, skew, count",
    [
        ([1], None, None, None, 1),
        ([1, 2], 0.7071068, 0.5, None, 2),
        ([3, 3, 3], 0, 0, 0, 3),
        ([1, 2, 4, 9], 3.5590260, 12.6666667, 1.3309377, 4),
        ([None, 1, 2, 5], 2.0816660, 4.3333333, 1.2933428, 3),
    ],
)
def test_sample_statistics(spark, values, std, var, skew, count):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = df.agg(*[BY_NAME[f]("x").alias(f) for f in ("std", "var", "skew", "count")]).first()
    for name, want in (("std", std), ("var", var), ("skew", skew), ("count", count)):
        assert got[name] == (None if want is None else pytest.approx(want, abs=1e-6)), name
