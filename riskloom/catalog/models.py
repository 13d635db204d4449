"""Sampling, training and scoring.

The queries that fit and score share one fit of the full model (`estimators.FULL_MODEL`, 1000 trees) per session. Those
that fit many models (cross-validation, grid search, learning curve: 3, 13 and 30 fits) grow `TREES` trees in each.
"""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog.registry import MODULUS, linked, logins, query, rounded, sql, trades
from riskloom.model import estimators, sampling, scoring, trees, validation
from riskloom.operators.shaping import union_all
from riskloom.plans.tables import transfer_data
from riskloom.session import freeze
from riskloom.sources.fixtures import test_part, train_part

TREES = 20

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _model_table(spark: SparkSession, d: str, part: str) -> DataFrame:
    """Train or test table, written once per session."""
    at = (spark.sparkContext.applicationId, d, part)
    if at not in _stored:
        trade = trades(spark, d)
        chosen = train_part(trade, "rowkey") if part == "train" else test_part(trade, "rowkey").drop("is_risk")
        _stored[at] = validation.stored(transfer_data(logins(spark, d), chosen, "v3", MODULUS))
    return _stored[at]


def _boosted(table: DataFrame):
    return estimators.risk_pipeline(table, estimators.boosted_trees(trees=TREES))


_models: dict[tuple[str, str], PipelineModel] = {}


def _model(spark: SparkSession, d: str) -> PipelineModel:
    """The boosted trees on all training rows, fitted once per session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _models:
        train = _model_table(spark, d, "train")
        full = estimators.boosted_trees(**estimators.FULL_MODEL)
        _models[at] = scoring.fit(estimators.risk_pipeline(train, full), train)
    return _models[at]


@query(
    "m1_undersample",
    sql(
        """SELECT rowkey, is_risk FROM trade WHERE is_risk = 1 UNION ALL
        SELECT rowkey, is_risk FROM (SELECT rowkey, is_risk, row_number() OVER (ORDER BY md5('27:' || rowkey), rowkey) AS n
          FROM trade WHERE is_risk = 0) WHERE n <= (SELECT count(*) FROM trade WHERE is_risk = 1)""",
        "trade",
    ),
)
def m1(spark, d):
    return sampling.undersample(trades(spark, d).select("rowkey", "is_risk"))


@query(
    "m1_undersample_share",
    sql(
        "SELECT rowkey FROM trade WHERE is_risk = 1 OR ('0x' || substr(md5('27:' || rowkey), 1, 8))::BIGINT < 1073741824",
        "trade",
    ),
)
def m1_share(spark, d):
    return sampling.undersample_by_share(trades(spark, d), 0.25).select("rowkey")


@query("m2_boosted_trees")
def m2(spark, d):
    return scoring.predict_probability(_model(spark, d), _model_table(spark, d, "test"))


@query("m3_other_classifiers")
def m3(spark, d):
    train, test = _model_table(spark, d, "train"), _model_table(spark, d, "test")
    parts = estimators.scaled_components(2)
    others = {
        "forest": (estimators.random_forest(), None),
        "tree": (estimators.decision_tree(), None),
        "logistic": (estimators.logistic_regression("components"), parts),
    }
    out = test.select("rowkey")
    for name, (classifier, between) in others.items():
        model = scoring.fit(estimators.risk_pipeline(train, classifier, between), train)
        out = out.join(scoring.predict(model, test).withColumnRenamed("is_risk", name), "rowkey")
    return out


@query(
    "m4_fbeta",
    sql(
        """SELECT tp, fp, fn, round(CASE WHEN tp > 0 THEN 1.01 * tp / (1.01 * tp + 0.01 * fn + fp) ELSE 0 END, 6) AS fbeta
        FROM (SELECT count(*) FILTER (WHERE is_risk = 1 AND p = 1) AS tp, count(*) FILTER (WHERE is_risk = 0 AND p = 1) AS fp,
            count(*) FILTER (WHERE is_risk = 1 AND p = 0) AS fn
          FROM (SELECT is_risk, CASE WHEN login_city = 2 THEN 1 ELSE 0 END AS p FROM linked))""",
        "linked",
    ),
)
def m4(spark, d):
    guess = F.when(F.col("login_city") == 2, 1).otherwise(0)
    return validation.fbeta(linked(spark, d).withColumn("prediction", guess)).withColumn("fbeta", F.round("fbeta", 6))


@query(
    "m5_folds",
    sql("SELECT rowkey, CAST(('0x' || substr(md5('27:' || rowkey), 1, 8))::BIGINT % 10 AS INT) AS fold FROM trade", "trade"),
)
def m5_folds(spark, d):
    return sampling.with_folds(trades(spark, d).select("rowkey"), 10)


@query(
    "m5_stratified_folds",
    sql(
        """SELECT rowkey, is_risk, CAST((row_number() OVER (PARTITION BY is_risk ORDER BY md5('27:' || rowkey), rowkey) - 1) % 10 AS INT)
          AS fold FROM trade""",
        "trade",
    ),
)
def m5_stratified(spark, d):
    return sampling.stratified_folds(trades(spark, d).select("rowkey", "is_risk"), 10)


@query("m5_cross_validation")
def m5(spark, d):
    train = _model_table(spark, d, "train")
    return validation.cross_validate(_boosted(train), train, k=3)


@query("m6_grid_search")
def m6(spark, d):
    train = _model_table(spark, d, "train")
    return validation.grid_search(_boosted(train), train, k=3)[0]


@query(
    "m7_learning_samples",
    sql(
        """SELECT n / 10.0::DOUBLE AS fraction, out AS fold, count(*) AS "rows", CAST(sum(rowkey) AS BIGINT) AS keys
        FROM (SELECT rowkey, out, row_number() OVER (PARTITION BY out ORDER BY md5('28:' || rowkey), rowkey) AS place,
            count(*) OVER (PARTITION BY out) AS train
          FROM (SELECT rowkey, (row_number() OVER (PARTITION BY is_risk ORDER BY md5('27:' || rowkey), rowkey) - 1) % 3 AS fold FROM trade)
            JOIN (SELECT CAST(unnest(range(3)) AS INT) AS out) ON fold <> out)
          JOIN (SELECT unnest(range(1, 11)) AS n) ON place <= train * n // 10
        GROUP BY ALL""",
        "trade",
    ),
)
def m7_samples(spark, d):
    """Size and sum of keys of each of the learning curve's training samples."""
    folded = sampling.stratified_folds(trades(spark, d).select("rowkey", "is_risk"), 3)
    placed = freeze(sampling.with_train_places(folded, 3), "places")
    sizes = validation.training_sizes(placed, 3)
    parts = []
    for i, n in sizes.items():
        train = placed.where(F.col("fold") != i)
        taken = [F.when(F.col(f"place_{i}") <= sampling.whole_part(F.lit(n), f), F.lit(f)) for f in (j / 10 for j in range(1, 11))]
        parts.append(train.select("rowkey", F.lit(i).alias("out"), F.explode(F.array_compact(F.array(*taken))).alias("fraction")))
    rows = union_all(*parts)
    return rows.groupBy("fraction", F.col("out").alias("fold")).agg(F.count(F.lit(1)).alias("rows"), F.sum("rowkey").alias("keys"))


@query("m7_learning_curve")
def m7(spark, d):
    train = _model_table(spark, d, "train")
    return validation.learning_curve(_boosted(train), train, k=3, parallelism=4)


@query("m8_fit_all")
def m8(spark, d):
    return validation.fbeta(_model(spark, d).transform(_model_table(spark, d, "train")))


@query("m9_predict")
def m9(spark, d):
    return scoring.predict(_model(spark, d), _model_table(spark, d, "test"))


@query("m10_probability_cut")
def m10(spark, d):
    scored = scoring.predict_probability(_model(spark, d), _model_table(spark, d, "test"))
    return scoring.cut_probability(scored)


@query(
    "m11_submission",
    sql(
        "SELECT rowkey, CASE WHEN login_device = 3 THEN 1 ELSE 0 END AS is_risk FROM linked WHERE rowkey % 5 = 0",
        "linked",
    ),
)
def m11(spark, d):
    test = test_part(linked(spark, d), "rowkey").drop("is_risk")
    known = test.where("login_id is not null").select("rowkey", (F.col("login_device") == 3).cast("int").alias("is_risk"))
    return scoring.submission(test, known)


@query("m11_submission_of_model")
def m11_model(spark, d):
    predicted = scoring.predict(_model(spark, d), _model_table(spark, d, "test"))
    return scoring.submission(test_part(trades(spark, d), "rowkey"), predicted)


@query(
    "m12_hold_out",
    sql(
        """SELECT rowkey, CASE WHEN ('0x' || substr(md5('1:' || rowkey), 1, 8))::BIGINT < 3435973836 THEN 'train' ELSE 'test'
          END AS part FROM trade""",
        "trade",
    ),
)
def m12(spark, d):
    train, test = sampling.hold_out(trades(spark, d).select("rowkey"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "m12_hold_out_exact",
    sql(
        """SELECT rowkey, CASE WHEN row_number() OVER (ORDER BY md5('1:' || rowkey), rowkey) <= count(*) OVER () * 8 // 10
          THEN 'train' ELSE 'test' END AS part FROM trade""",
        "trade",
    ),
)
def m12_exact(spark, d):
    train, test = sampling.hold_out_exact(trades(spark, d).select("rowkey"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# One tree of two levels that SQL can grow and apply as well.
_CUT = [
    "city_Counts", "hours", "result_no1_Counts", "st", "timelong_max", "timelong_min", "trade_time_sub_day",
    "trade_time_sub_day_max", "trade_time_sub_day_min", "type_Counts", "whole_sec_false", "whole_sec_true",
]


def _part_sql(part: str) -> str:
    """The V3 model table of the trades of a part, in SQL."""
    body = sql("SELECT * EXCLUDE (trade_time) FROM users_v3 JOIN trade_v3 USING (id)", "users_v3", "trade_v3")
    mine = f"WHERE event_type = 'purchase' AND event_id % 5 {'<>' if part == 'train' else '='} 0"
    return f"SELECT rowkey, is_risk, {', '.join(_CUT)} FROM ({body.replace("WHERE event_type = 'purchase'", mine)})"


def _value_sql(split: str) -> str:
    """A row's value in the column that a split names."""
    return f"CASE {split}.col {' '.join(f"WHEN '{c}' THEN {c}" for c in _CUT)} END"


def _split_sql(rows: str) -> str:
    """The best cut of a table of rows: one row, or none if they are pure or no column parts them."""
    values = ", ".join(f"{{'col': '{c}', 'v': CAST({c} AS BIGINT)}}" for c in _CUT)
    return f"""SELECT * FROM (
        SELECT u.col, u.v AS cut, sum(count(*)) OVER w AS ln, sum(sum(is_risk)) OVER w AS lk, any_value(n) AS n, any_value(k) AS k
        FROM (SELECT is_risk, count(*) OVER () AS n, sum(is_risk) OVER () AS k, unnest([{values}]) AS u FROM {rows})
        GROUP BY u.col, u.v WINDOW w AS (PARTITION BY u.col ORDER BY u.v NULLS FIRST))
      WHERE cut IS NOT NULL AND ln < n AND k > 0 AND k < n
      ORDER BY CAST(lk * lk + (ln - lk) * (ln - lk) AS DOUBLE) / ln
        + CAST((k - lk) * (k - lk) + (n - ln - k + lk) * (n - ln - k + lk) AS DOUBLE) / (n - ln) DESC, col, cut LIMIT 1"""


def _tree_sql(body: str) -> str:
    return f"""WITH n1 AS ({_part_sql('train')}), test AS ({_part_sql('test')}), s1 AS ({_split_sql('n1')}),
      n2 AS (SELECT n1.* FROM n1, s1 WHERE NOT coalesce({_value_sql('s1')} > cut, false)),
      n3 AS (SELECT n1.* FROM n1, s1 WHERE coalesce({_value_sql('s1')} > cut, false)),
      s2 AS ({_split_sql('n2')}), s3 AS ({_split_sql('n3')}),
      whole AS (SELECT count(*) AS n, sum(is_risk) AS k FROM n1)
    {body}"""


def _leaf_sql(split: str, n: str, k: str) -> str:
    return f"""CASE WHEN {split}.col IS NULL THEN CAST({k} AS DOUBLE) / {n}
      WHEN {_value_sql(split)} > {split}.cut THEN CAST({split}.k - {split}.lk AS DOUBLE) / ({split}.n - {split}.ln)
      ELSE CAST({split}.lk AS DOUBLE) / {split}.ln END"""


_TREE_PROBABILITY = f"""SELECT rowkey, CASE WHEN s1.col IS NULL THEN CAST(whole.k AS DOUBLE) / whole.n
      WHEN {_value_sql('s1')} > s1.cut THEN {_leaf_sql('s3', '(s1.n - s1.ln)', '(s1.k - s1.lk)')}
      ELSE {_leaf_sql('s2', 's1.ln', 's1.lk')} END AS probability
    FROM test, whole LEFT JOIN s1 ON true LEFT JOIN s2 ON true LEFT JOIN s3 ON true"""

_trees: dict[tuple[str, str], trees.Node] = {}


def _tree(spark: SparkSession, d: str) -> trees.Node:
    at = (spark.sparkContext.applicationId, d)
    if at not in _trees:
        _trees[at] = trees.grow(_model_table(spark, d, "train"), _CUT, 2)
    return _trees[at]


@query("m2_one_tree", _tree_sql(f"SELECT rowkey, round(probability, 6) AS probability FROM ({_TREE_PROBABILITY})"))
def m2_tree(spark, d):
    """Probabilities by an exact tree, applied as a SQL expression."""
    return rounded(trees.predict_probability(_tree(spark, d), _model_table(spark, d, "test")))


@query(
    "m8_one_tree",
    _tree_sql(
        """SELECT 1 AS node, col AS "column", cut, CAST(n AS BIGINT) AS "rows", CAST(k AS BIGINT) AS risky FROM s1
        UNION ALL SELECT 2, col, cut, CAST(n AS BIGINT), CAST(k AS BIGINT) FROM s2
        UNION ALL SELECT 3, col, cut, CAST(n AS BIGINT), CAST(k AS BIGINT) FROM s3"""
    ),
)
def m8_tree(spark, d):
    """The cuts of the tree fitted on all training rows."""
    root = _tree(spark, d)
    nodes = [(i, at) for i, at in ((1, root), (2, root.below), (3, root.above)) if at is not None and at.column is not None]
    rows = [(i, at.column, at.cut, at.rows, at.risky) for i, at in nodes]
    return spark.createDataFrame(rows, "node int, column string, cut long, rows long, risky long")


@query(
    "m9_one_tree",
    _tree_sql(f"SELECT rowkey, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS is_risk FROM ({_TREE_PROBABILITY})"),
)
def m9_tree(spark, d):
    scored = trees.predict_probability(_tree(spark, d), _model_table(spark, d, "test"))
    return scoring.cut_probability(scored, 0.5)


@query(
    "m10_one_tree_cut",
    _tree_sql(
        f"""SELECT rowkey, CASE WHEN probability >= (SELECT CAST(k AS DOUBLE) / n FROM whole) THEN 1 ELSE 0 END AS is_risk
        FROM ({_TREE_PROBABILITY})"""
    ),
)
def m10_tree(spark, d):
    """Cut at the share of risk rows in the training table."""
    tree = _tree(spark, d)
    scored = trees.predict_probability(tree, _model_table(spark, d, "test"))
    return scoring.cut_probability(scored, tree.risky / tree.rows)
