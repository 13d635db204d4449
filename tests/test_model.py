import pytest
from pyspark.sql import functions as F

from riskloom.model import estimators, sampling, scoring, validation
from riskloom.plans.tables import transfer_data
from riskloom.sources import fixtures


@pytest.fixture(scope="module")
def table(spark):
    sf = "/root/testdata/sf0.01"
    return validation.stored(transfer_data(fixtures.logins(spark, sf), fixtures.trades(spark, sf), "v3", 10))


def small(table, trees=2):
    return estimators.risk_pipeline(table, estimators.boosted_trees(trees=trees, depth=3))


def test_undersample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("rowkey"), (F.col("id") % 50 == 0).cast("int").alias("is_risk"))
    out = sampling.undersample(df)
    counts = {r["is_risk"]: r["count"] for r in out.groupBy("is_risk").count().collect()}
    assert counts == {0: 100, 1: 100}
    assert sorted(out.collect()) == sorted(sampling.undersample(df.repartition(5)).collect())


@pytest.mark.parametrize("sortable", [0, 3, 100_000])
@pytest.mark.parametrize("n", [0, 1, 37, 300, 400])
def test_smallest_draws_against_a_sort(spark, monkeypatch, n, sortable):
    monkeypatch.setattr(sampling, "_SORTABLE", sortable)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    df = spark.range(300).select(F.col("id").alias("k"))
    want = df.orderBy(sampling.draw_text("k", 3)).limit(n).collect()
    assert sorted(sampling.smallest_draws(df, n, "k", 3).collect()) == sorted(want)


def test_hold_out_and_folds_split_all_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("rowkey"))
    train, test = sampling.hold_out(df)
    assert train.count() + test.count() == 2000 and 1500 < train.count() < 1700
    folds = sampling.with_folds(df, 10).groupBy("fold").count().collect()
    assert len(folds) == 10 and sum(r["count"] for r in folds) == 2000


def test_fbeta_forms_agree(spark):
    data = [(1, 1.0)] * 7 + [(0, 1.0)] * 3 + [(1, 0.0)] * 5 + [(0, 0.0)] * 40
    df = spark.createDataFrame(data, "is_risk int, prediction double")
    own = validation.fbeta(df).first()["fbeta"]
    assert own == pytest.approx(validation.fbeta_evaluator().evaluate(df))
    p, r = 0.7, 7 / 12
    assert own == pytest.approx(1.01 * p * r / (0.01 * p + r))
    none = spark.createDataFrame([(1, 0.0), (0, 0.0)], "is_risk int, prediction double")
    assert validation.fbeta(none).first()["fbeta"] == 0


def test_missing_values_get_a_sentinel_and_a_flag(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 1, None)], "rowkey int, is_risk int, x double")
    stages = estimators.vector_stages(df)
    from pyspark.ml import Pipeline

    out = Pipeline(stages=stages).fit(df).transform(df).orderBy("rowkey").select("features").collect()
    assert [list(r[0]) for r in out] == [[2.0, 0.0], [-1.0, 1.0]]


def test_submission_has_every_key_once(spark, table):
    test = fixtures.test_part(fixtures.trades(spark, "/root/testdata/sf0.01"), "rowkey")
    model = scoring.fit(small(table), table)
    scored = scoring.predict_probability(model, fixtures.test_part(table, "rowkey"))
    out = scoring.submission(test, scoring.cut_probability(scored, 0.1))
    keys = [r["rowkey"] for r in out.collect()]
    assert sorted(keys) == sorted(r["rowkey"] for r in test.collect())
    assert {r["is_risk"] for r in out.collect()} <= {0, 1} and dict(out.dtypes)["is_risk"] == "int"
    assert scoring.total_risk(out).first()["total"] == sum(r["is_risk"] for r in out.collect())


def test_cross_validation_grid_and_curve(spark, table):
    scores = validation.cross_validate(small(table, 1), table, k=2)
    assert [r["fold"] for r in scores.orderBy("fold").collect()] == [0, 1]
    lines, best = validation.grid_search(small(table, 1), table, depths=(2, 3), rates=(0.3,), k=2)
    assert lines.count() == 2 and best.count() == 1
    curve = validation.learning_curve(small(table, 1), table, fractions=(0.5, 1.0), k=2).orderBy("fraction").collect()
    assert [r["fraction"] for r in curve] == [0.5, 1.0] and curve[0]["train_size"] < curve[1]["train_size"]


def test_full_settings():
    full = estimators.boosted_trees(**estimators.FULL_MODEL)
    assert (full.getMaxIter(), full.getStepSize(), full.getMaxDepth()) == (1000, 0.3, 5)
    assert (full.getSubsamplingRate(), full.getFeatureSubsetStrategy(), full.getSeed()) == (0.8, "0.8", 27)


def test_flags_of_a_stored_model_table(spark, sf):
    from riskloom.catalog.registry import logins, trades
    from riskloom.plans.tables import transfer_data

    table = validation.stored(transfer_data(logins(spark, sf), trades(spark, sf), "v3", 10))
    columns = estimators.feature_columns(table)
    flagged = estimators.optional_columns(table, columns)
    assert flagged and all(c.startswith("trade_time_sub_day") for c in flagged)


def test_draws_of_missing_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_SORTABLE", 5)
    df = spark.createDataFrame([(None, i) for i in range(4)] + [(7, i) for i in range(30)] + [(8, 1)], "rowkey long, v int")
    for n in (0, 1, 4, 5, 20, 33, 35, 50):
        got = sampling.smallest_draws(df, n, "rowkey", 3)
        assert got.columns == df.columns and got.count() == min(n, 35)
        assert sorted(got.collect(), key=str) == sorted(sampling.smallest_draws(df.repartition(3), n, "rowkey", 3).collect(), key=str)
    labelled = df.selectExpr("rowkey", "cast(v = 1 as int) as is_risk")
    assert sampling.undersample(labelled).count() == 2 * labelled.where("is_risk = 1").count()


def test_best_model_of_the_grid_predicts(spark, table):
    _, best, model = validation.searched(small(table, 1), table, depths=(2, 3), rates=(0.3,), k=2)
    assert best.count() == 1 and scoring.predict(model, table).count() == table.count()


def test_v2_and_undersampled_tables_end_to_end(spark, sf):
    from riskloom.plans.tables import trade_table_v2
    from riskloom.plans.trade_features import linked_trades

    seen, trade = fixtures.logins(spark, sf), fixtures.trades(spark, sf)
    linked = linked_trades(trade, seen).select(*trade.columns, "login_id")
    v2 = validation.stored(trade_table_v2(seen, linked))
    model = scoring.fit(small(v2, 1), v2)
    unlabelled = trade_table_v2(seen, linked.drop("is_risk"))
    assert "is_risk" not in unlabelled.columns
    assert scoring.predict(model, unlabelled).count() == unlabelled.count() == v2.count() > 0
    even = validation.stored(sampling.undersample(v2))
    assert scoring.predict(scoring.fit(small(even, 1), even), v2).count() == v2.count()


def test_forest_keeps_the_rows_nodes_and_grows_the_same_trees(spark):
    rows = spark.range(400).select(
        F.col("id").alias("rowkey"),
        (F.col("id") % 37).alias("a"),
        (F.col("id") % 11).alias("b"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("c"),
        (F.col("id") * 7919 % 101 < 30).cast("int").alias("is_risk"),
    )
    grown = []
    for forest in (estimators.random_forest(), estimators.random_forest().setCacheNodeIds(False)):
        grown.append(scoring.fit(estimators.risk_pipeline(rows, forest), rows).stages[-1])
    assert estimators.random_forest().getCacheNodeIds()
    a, b = ([t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in grown)
    assert len(a) == 20 and a == b


@pytest.mark.parametrize("settings", [{}, {"row_share": 0.5, "depth": 3, "column_share": 0.34}, {"row_share": 1.0, "column_share": 1.0}])
def test_small_tables_grow_the_librarys_trees_without_a_job_per_level(spark, settings):
    from pyspark.ml.classification import GBTClassifier

    rows = spark.range(0, 27_000, 1, 1).select(
        F.col("id").alias("rowkey"),
        (F.col("id") * 7919 % 1009 / 7).alias("a"),
        (F.col("id") % 11 - 5).alias("b"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("c"),
        F.lit(4).alias("d"),
        ((F.col("id") * 104_729 % 997 + F.col("id") % 11 * 30) % 1000 < 300).cast("int").alias("is_risk"),
    )
    for part, trees in ((rows, 6), (rows.where("rowkey < 700"), 12)):  # bins from a sample, and from all rows
        own = estimators.boosted_trees(trees=trees, **settings)
        library = GBTClassifier()
        for param in own.params:
            if own.isSet(param):
                library.set(library.getParam(param.name), own.getOrDefault(param))
        spark.sparkContext.setJobGroup(own.uid, "")
        mine = scoring.fit(estimators.risk_pipeline(part, own), part)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(own.uid))
        spark.sparkContext.setJobGroup(library.uid, "")
        theirs = scoring.fit(estimators.risk_pipeline(part, library), part)
        a, b = (m.stages[-1] for m in (mine, theirs))
        assert a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]
        assert a.treeWeights == b.treeWeights and a.featureImportances == b.featureImportances
        said = [sorted(scoring.predict_probability(m, part).collect()) for m in (mine, theirs)]
        assert said[0] == said[1]
        assert jobs < 3 * trees, "a job for every level of every tree"


def test_what_one_task_does_not_cover_goes_to_the_library(spark, monkeypatch):
    from riskloom.model import boosting

    rows = spark.range(0, 300, 1, 3).select(
        F.col("id").alias("rowkey"), (F.col("id") % 7).alias("a"), (F.col("id") * 7919 % 101 < 30).cast("int").alias("is_risk")
    )
    small = scoring.fit(estimators.risk_pipeline(rows, estimators.boosted_trees(trees=3)), rows)
    monkeypatch.setattr(boosting, "CELLS", 100)
    large = scoring.fit(estimators.risk_pipeline(rows, estimators.boosted_trees(trees=3)), rows)
    assert len(small.stages[-1].trees) == len(large.stages[-1].trees) == 3
    odd = rows.withColumn("is_risk", F.col("is_risk") * 2)
    with pytest.raises(Exception, match="(?i)label"):
        scoring.fit(estimators.risk_pipeline(odd, estimators.boosted_trees(trees=1)), odd)
