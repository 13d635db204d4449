"""One row of login behaviour per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import moments
from riskloom.operators.aggregates import aggregate_many, failed_login_aggregates, group, whole_second_aggregates
from riskloom.operators.ordered import with_gap_parts

# Columns whose different values are counted, per feature version.
COUNTED = {
    "v1": ["device", "ip", "log_from", "type", "city", "log_id"],
    "v3": ["type", "city"],
}

V2_COUNTED = ["device", "log_from", "city", "result", "type"]
V2_DURATION = ["min", "max", "std", "var", "mean", "skew"]
V2_GAP = ["min", "max", "std", "var", "mean", "skew", "mad"]
V2_GAPS = ["login_diff_day", "login_diff_seconds"]


def _duration_statistics(logins: DataFrame, column: str = "timelong") -> dict[str, Column]:
    """From exact sums where the durations are whole numbers, as they should be."""
    built_in = {"mean": F.avg(column), "var": F.var_samp(column), "std": F.stddev_samp(column)}
    statistics = moments.one_pass(column) if moments.is_whole(logins, column) else built_in
    return {
        f"{column}_min": F.min(column),
        f"{column}_max": F.max(column),
        f"{column}_Mean": statistics["mean"],
        f"{column}_var": statistics["var"],
        f"{column}_std": statistics["std"],
    }


def plain_features(logins: DataFrame, modulus: int = 1000) -> dict[str, Column]:
    """Features V1 and V3 that are no counts of different values, and `_has_failed`."""
    failed, has_failed = failed_login_aggregates()
    return {
        **whole_second_aggregates("timelong", modulus),
        **_duration_statistics(logins),
        "result_no1_Counts": failed,
        "_has_failed": has_failed,
    }


def user_features(logins: DataFrame, version: str = "v3", modulus: int = 1000) -> DataFrame:
    """Login features V1 or V3 per user.

    Users without a row that is not a successful login have no row, and missing
    statistics are 0.
    """
    plain = plain_features(logins, modulus)
    different = {f"{c}_Counts": F.count_distinct(c) for c in COUNTED[version]}
    out = group(logins.where(F.col("id").isNotNull()), plain, different).where("_has_failed").drop("_has_failed")
    return out.na.fill(0, [c for c in out.columns if c != "id"])


def login_gaps(logins: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Logins with the gap to the user's previous login, in days and seconds of the day."""
    return with_gap_parts(logins, ["id"], "time", "log_id", *V2_GAPS, hot=hot)


def user_features_v2(gapped: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Login features V2 per user, from logins with their gaps."""
    wanted = [(V2_COUNTED, "nunique"), ("timelong", V2_DURATION), (V2_GAPS, V2_GAP)]
    return aggregate_many(gapped, wanted, "id", hot=hot)
