"""What is exact by design: statistics of whole numbers, places, samples, folds, splits."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import draw_text
from riskloom.model import sampling, trees, validation
from riskloom.operators import aggregates, ordered, sketches
from riskloom.operators.hotkeys import HOT_ROWS_CONF
from riskloom.plans import tables
from riskloom.plans.login_facts import LoginFacts
from riskloom.plans.user_features import user_features
from riskloom.sources import files, fixtures
from riskloom.session import scratch_path


def groups():
    rng = random.Random(1)
    made = {"one": [7], "two": [-3, 10], "same": [5] * 4, "large": [10**12 + rng.randint(0, 10) for _ in range(50)]}
    made["wide"] = [rng.randint(-(10**12), 10**12) for _ in range(60)]
    made["skew"] = [0] * 30 + [86399, 5, 20493]
    return made


def test_statistics_of_whole_numbers(spark):
    rows = [(k, x) for k, values in groups().items() for x in [*values, None]] + [("none", None), (None, 3)]
    df = spark.createDataFrame(rows, "id string, x long").repartition(7)
    got = {r["id"]: r for r in aggregates.aggregate(df, "x", ["mean", "var", "std", "skew", "mad", "min"]).collect()}
    plain = {r["id"]: r for r in aggregates.aggregate(df, "x", ["mean", "var", "std"]).collect()}
    assert set(got) == {*groups(), "none"}
    for k, values in groups().items():
        n, mean = len(values), Fraction(sum(values), len(values))
        assert got[k]["x_mean"] == plain[k]["x_mean"] == float(mean)
        assert got[k]["x_mad"] == pytest.approx(float(sum(abs(x - mean) for x in values) / n), rel=1e-15)
        if n == 1:
            assert got[k]["x_var"] is None and got[k]["x_skew"] is None and plain[k]["x_var"] is None
            continue
        var = sum((x - mean) ** 2 for x in values) / (n - 1)
        for found in (got, plain):
            assert found[k]["x_var"] == pytest.approx(float(var), rel=1e-15)
            assert found[k]["x_std"] == pytest.approx(float(var) ** 0.5, rel=1e-15)
        if n > 2:
            m2, m3 = (float(sum((x - mean) ** p for x in values) / n) for p in (2, 3))
            due = m3 / m2**1.5 * (n * (n - 1)) ** 0.5 / (n - 2) if m2 else 0.0
            assert got[k]["x_skew"] == pytest.approx(due, rel=1e-12, abs=1e-12)
    assert got["none"]["x_mean"] is None and got["none"]["x_mad"] is None


def test_layout_does_not_show_in_a_single_bit(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 10**6)) for _ in range(3000)]
    names = ["mean", "var", "std", "skew", "mad"]
    seen = set()
    for parts in (1, 3, 16):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "id int, x long").repartition(parts)
        for hot in (None, spark.createDataFrame([(1, 3, 700)], "id int, _copies int, _rows long")):
            seen.add(tuple(sorted(map(tuple, aggregates.aggregate(df, "x", names, hot=hot).collect()))))
    assert len(seen) == 1


def test_v2_tables_are_the_same_to_the_bit(spark, sf):
    login = fixtures.logins(spark, sf).withColumn("id", F.when(F.col("log_id") % 3 == 0, 7).otherwise(F.col("id")))
    got = []
    for least in ("20", str(10**12)):
        spark.conf.set(HOT_ROWS_CONF, least)
        got.append(sorted(map(tuple, tables.login_table_v2(login).collect())))
    spark.conf.unset(HOT_ROWS_CONF)
    assert got[0] and got[0] == got[1]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_numbered(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.random()) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x double").repartition(6)
    got = {r["i"]: r["number"] for r in ordered.numbered(df, by, ["x", "i"]).collect()}
    for key in {r[0] for r in rows} if by else {0}:
        mine = sorted((r for r in rows if not by or r[0] == key), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in mine] == list(range(len(mine)))
    assert ordered.numbered(df.where("false"), by, ["x", "i"]).count() == 0


def test_whole_table_order(spark):
    rows = [(i * 7919 % 1000, i, None if i % 50 == 3 else i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "t int, k int, x int").repartition(5)
    got = {r["k"]: r for r in ordered.running_total(df, [], ["t", "k"], {"total": "x"}).collect()}
    before = {r["k"]: r["x_diff"] for r in ordered.difference(df, [], ["t", "k"], ["x"]).collect()}
    total, last = 0, None
    for t, k, x in sorted(rows):
        total += x or 0
        assert got[k]["total"] == total and before[k] == (None if x is None or last is None else x - last)
        last = x
    for empty in (ordered.running_total(df.where("false"), [], ["t"], {"s": "x"}), ordered.difference(df.where("false"), [], ["t"], ["x"])):
        assert empty.count() == 0


def test_folds_and_samples(spark):
    df = spark.createDataFrame([(i, int(i % 9 == 0) if i % 50 else None) for i in range(700)], "rowkey long, is_risk int").repartition(4)
    folded = sampling.stratified_folds(df, 4)
    sizes = {}
    for r in folded.groupBy("is_risk", "fold").count().collect():
        sizes.setdefault(r["is_risk"], []).append(r["count"])
    assert len(sizes) == 3 and all(len(s) == 4 and max(s) - min(s) <= 1 for s in sizes.values())
    rows = sampling.with_train_places(folded, 4).collect()
    assert validation.training_sizes(folded, 4) == {i: sum(r["fold"] != i for r in rows) for i in range(4)}
    for i in range(4):
        assert sorted(r[f"place_{i}"] for r in rows if r["fold"] != i) == list(range(1, sum(r["fold"] != i for r in rows) + 1))
    train, test = sampling.hold_out_exact(df, 0.7)
    assert train.count() == 490 and test.count() == 210 and train.intersect(test).count() == 0
    due = {r["rowkey"] for r in df.withColumn("d", draw_text("rowkey", 1)).orderBy("d").limit(490).collect()}
    assert {r["rowkey"] for r in train.collect()} == due


def gini(rows, columns):
    best = None
    n, k = len(rows), sum(r[-1] for r in rows)
    for at, c in sorted(enumerate(columns), key=lambda x: x[1]):
        for cut in sorted({r[at] for r in rows if r[at] is not None}):
            low = [r for r in rows if r[at] is None or r[at] <= cut]
            if len(low) == n:
                continue
            lk = sum(r[-1] for r in low)
            score = (lk**2 + (len(low) - lk) ** 2) / len(low) + ((k - lk) ** 2 + (n - len(low) - k + lk) ** 2) / (n - len(low))
            if best is None or score > best[0]:
                best = (score, c, cut, len(low), lk)
    return best


def test_tree(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(20)]), rng.randint(0, 3)) for _ in range(400)]
    rows = [(a, b, int((a or 0) > 12 and b != 2 or rng.random() < 0.1)) for a, b in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rowkey int, a int, b int, is_risk int")
    root = trees.grow(df, ["b", "a"], 2)
    assert (root.column, root.cut, root.below.rows, root.below.risky) == gini(rows, ["a", "b"])[1:]
    below = [r for r in rows if not (r[0 if root.column == "a" else 1] or 0) > root.cut]
    assert (root.below.column, root.below.cut) == gini(below, ["a", "b"])[1:3]
    shares = {r["rowkey"]: r["probability"] for r in trees.predict_probability(root, df).collect()}
    for node in (root.below.below, root.above.above):
        assert 0 <= node.risky <= node.rows
    assert sum(shares.values()) == pytest.approx(sum(r[-1] for r in rows))
    assert trees.grow(df.where("false"), ["a"], 2).rows == 0 and trees.grow(df.where("is_risk = 1"), ["a"], 2).column is None
    columns = [f"c{i}" for i in range(10)]
    drawn = trees.drawn_columns(df, columns, 0.8, 27)
    assert len(drawn) == 8 and drawn == [c for c in columns if c in drawn] and drawn == trees.drawn_columns(df, columns, 0.8, 27)


def test_sketches_merge(spark):
    rows = [(i % 3, f"2020-01-{1 + i % 9:02d} 10:00:00", i % 700) for i in range(6000)] + [(None, "2020-01-01 00:00:00", 1), (1, None, 1)]
    df = spark.createDataFrame(rows, "id int, t string, v int").withColumn("time", F.col("t").cast("timestamp_ntz"))
    got = {r["id"]: r for r in sketches.merged_counts(sketches.daily_sketches(df, ["v"]), ["v"]).collect()}
    exact = {k: len({v for i, _, v in rows if i == k}) for k in range(3)}
    assert set(got) == {0, 1, 2}
    assert all(abs(got[k]["v_Counts"] - n) <= n * sketches.relative_error() + 1 for k, n in exact.items())
    assert all(got[k]["days"] == len({t for i, t, _ in rows if i == k and t}) for k in exact)


def test_login_facts_are_the_user_features(spark, sf):
    login = fixtures.logins(spark, sf).withColumn("device", F.when(F.col("log_id") % 5 != 0, F.col("device")))
    for version in ("v1", "v3"):
        facts = LoginFacts(login, ["device", "city"], version, 10, hours=True)
        due = user_features(login, version, 10)
        got = facts.users().select(*due.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, due.collect()))
        share = facts.counts("device").join(facts.users(), "id").select("id", "device", (F.col("_n") / F.col("device_all")).alias("device_scale"))
        users = {r["id"] for r in due.collect()}
        plain = [tuple(r) for r in aggregates.usage_share(login, "device").collect() if r["id"] in users]
        assert sorted(map(tuple, share.collect())) == sorted(plain)


def test_types_of_a_csv(spark):
    path = scratch_path(spark, "typed")
    lines = ["a,b,c,d", "01,1,2015-01-29 13:38:53.5,x", "02,2,2015-01-30 01:00:00,", "03,many,2015-02-01 00:00:00,z"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    assert dict(files.read_csv(spark, path).dtypes) == {"a": "int", "b": "string", "c": "timestamp_ntz", "d": "string"}
    df = files.read_csv(spark, path, overrides={"a": "string"})
    assert [r["a"] for r in df.collect()] == ["01", "02", "03"]
    good, bad = files.ingest_csv(spark, path, {"a": "string", "b": "int"})
    assert good.count() == 2 and [r["a"] for r in good.orderBy("a").collect()] == ["01", "02"]
    assert [r[0] for r in bad.collect()] == [lines[-1]] and bad.count() == 1
    with pytest.raises(ValueError):
        files.read_csv(spark, path, overrides={"z": "int"})


