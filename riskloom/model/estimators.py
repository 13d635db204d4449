"""Feature vectors and classifiers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame

from riskloom.model.boosting import BoostedTrees
from riskloom.operators.shaping import feature_columns

LABEL = "is_risk"
MISSING = -1.0

# Settings of the full model: trees, rate, depth, row and column shares, seed.
FULL_MODEL = {"trees": 1000, "rate": 0.3, "depth": 5, "row_share": 0.8, "column_share": 0.8, "seed": 27}


# Features of the model tables that every row has, by how their names begin; a stored table calls all columns nullable.
_ALWAYS_THERE = (
    "whole_sec_", "timelong", "is_scan", "is_sec", "device_", "ip_", "log_from_", "type_", "city_", "result_", "log_id_",
    "st", "hours", "sub_l_time_mean",
)
# But in the V2 tables users with few rows lack these.
_V2_STATISTICS = ("timelong_std", "timelong_var", "timelong_skew")


def optional_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the feature columns that may be missing: gaps, their statistics and any nullable column not known here."""
    lacking = _V2_STATISTICS if "timelong_skew" in columns else ()
    return [c for c in columns if df.schema[c].nullable and (c in lacking or not c.startswith(_ALWAYS_THERE))]


def vector_stages(df: DataFrame, columns: list[str] | None = None, optional: list[str] | None = None) -> list:
    """Stages that put the feature columns, chosen by name, into one vector.

    A missing value becomes a sentinel, with a flag column beside it, since the tree
    learners take no missing values. Only columns that may be missing get a flag: `optional`, or those of `optional_columns`.
    """
    columns = columns or feature_columns(df)
    optional = optional_columns(df, columns) if optional is None else optional
    values = [f"coalesce(cast(`{c}` as double), {MISSING}D) as `x_{c}`" for c in columns]
    flags = [f"cast(`{c}` is null as double) as `missing_{c}`" for c in optional]
    fill = SQLTransformer(statement=f"select *, {', '.join(values + flags)} from __THIS__")
    inputs = [f"x_{c}" for c in columns] + [f"missing_{c}" for c in optional]
    return [fill, VectorAssembler(inputCols=inputs, outputCol="features")]


def boosted_trees(
    trees: int = 1000,
    rate: float = 0.3,
    depth: int = 5,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 27,
) -> BoostedTrees:
    """Boosted trees. The columns are drawn per node, which is the choice Spark offers."""
    return BoostedTrees(
        labelCol=LABEL,
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share),
        seed=seed,
    )


def random_forest(trees: int = 20, depth: int = 30, least_rows: int = 3, seed: int = 1) -> RandomForestClassifier:
    """Random forest; 30 is the deepest that Spark grows.

    Each row's node is kept beside it, so that the driver need not send the trees grown so far with every step.
    """
    return RandomForestClassifier(
        labelCol=LABEL, numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=seed, cacheNodeIds=True
    )


def decision_tree() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=LABEL, impurity="entropy")


def logistic_regression(features: str = "features") -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, featuresCol=features)


def scaled_components(k: int = 2) -> list:
    """Standardised features, then their first `k` principal components, as `components`."""
    return [
        StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled"),
        PCA(k=k, inputCol="scaled", outputCol="components"),
    ]


def risk_pipeline(df: DataFrame, classifier=None, between: list | None = None) -> Pipeline:
    """Vector stages, any stages between, and the classifier (boosted trees by default)."""
    return Pipeline(stages=[*vector_stages(df), *(between or []), classifier or boosted_trees()])
