"""What the features need to know of each user's logins, found by one scan and one shuffle of the log.

Counts of different values, shares of usage and the usual hour all begin with the different (user, value) pairs, and
the plain features with the user alone. Grouping sets give all of these in one pass, combined before the shuffle;
they are written once, and the rest is done on them: one grouping per user, and the joins that look a share up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.user_features import COUNTED, plain_features
from riskloom.session import freeze

_SET = "_set"
_N = "_n"
_TIME = ["_date", "_hour"]


def _number(columns: list[str], grouped: list[str]) -> int:
    """What grouping_id() says for the set of the user and `grouped`: a bit per column that is not in it."""
    return sum(1 << i for i, c in enumerate(reversed(columns)) if c not in grouped)


class LoginFacts:
    """The facts of a log, stored.

    `shares` are the columns whose share of usage is wanted; `version` adds the features of that version (None: none)
    and, with `hours`, the mean of the different hours of each day.
    """

    def __init__(self, logins: DataFrame, shares: list[str], version: str | None = None, modulus: int = 1000, hours: bool = False):
        self.shares, self.hours = shares, hours
        self.counted = COUNTED[version] if version else []
        self.plain = plain_features(logins, modulus) if version else {}
        values = list(dict.fromkeys([*self.counted, *shares]))
        self.columns = [*values, *(_TIME if hours else [])]
        sets = [[], *[[c] for c in values], *([_TIME] if hours else [])]
        sets = sets if self.plain else sets[1:]
        rows = logins.where(F.col("id").isNotNull())
        if hours:
            rows = rows.withColumns({"_date": F.to_date("time"), "_hour": F.hour("time")})
        found = rows.groupingSets([["id", *s] for s in sets], "id", *self.columns).agg(
            F.grouping_id().alias(_SET), F.count("log_id").alias(_N), *[a.alias(name) for name, a in self.plain.items()]
        )
        self.stored = freeze(found, "login-facts")

    def _in(self, *grouped: str):
        return F.col(_SET) == _number(self.columns, list(grouped))

    def users(self) -> DataFrame:
        """A row per user: features, `<column>_all` (rows with a value) for each share, and `l_time_mean`."""
        wanted = {name: F.max(F.when(self._in(), F.col(name))) for name in self.plain}
        wanted |= {f"{c}_Counts": F.count(F.when(self._in(c), F.col(c))) for c in self.counted}
        wanted |= {f"{c}_all": F.sum(F.when(self._in(c) & F.col(c).isNotNull(), F.col(_N))) for c in self.shares}
        if self.hours:
            wanted["l_time_mean"] = F.avg(F.when(self._in(*_TIME) & F.col("_date").isNotNull(), F.col("_hour")))
        out = self.stored.groupBy("id").agg(*[a.alias(name) for name, a in wanted.items()])
        features = [*self.plain, *[f"{c}_Counts" for c in self.counted]]
        if features:
            out = out.where("_has_failed").drop("_has_failed")
            out = out.na.fill(0, [c for c in features if c != "_has_failed"])
        return out.where(F.col("l_time_mean").isNotNull()) if self.hours else out

    def counts(self, column: str) -> DataFrame:
        """id, column, _n: a user's rows with each value."""
        return self.stored.where(self._in(column) & F.col(column).isNotNull()).select("id", column, _N)
