"""Samples that depend on the key and a seed alone, so they can be repeated anywhere."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import DRAWS, draw, draw_text
from riskloom.operators.ordered import numbered, running_total
from riskloom.operators.shaping import union_all

_DIGITS = 4
_LONGEST = 32  # digits of a draw
_SORTABLE = 100_000


def smallest_draws(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly the `n` rows with the smallest draws (all rows if fewer); a NULL key has the smallest draw of all.

    No sort of the table: counting rows by the leading digits of the draw tells where the n-th row lies, until the
    group that it falls in is small enough to sort, or cannot be split further. What is left is one filter on the
    draw and the key. Only if rows of one key straddle the cut are these settled by a hash of the whole row.
    """
    if n <= 0:
        return rows.limit(0)
    drawn = rows.withColumn("_draw", F.coalesce(draw_text(key, seed), F.lit("")))
    open_part, left, digits = drawn, n, 0
    while True:
        digits += _DIGITS
        lead = F.substring("_draw", 1, digits)
        # At most 16^4 groups at each step.
        sizes = open_part.groupBy(lead.alias("_lead")).count().collect()
        cut = None
        for size in sorted(sizes, key=lambda r: r["_lead"]):
            if size["count"] > left:
                cut = size
                break
            left -= size["count"]
        if cut is None:
            return rows
        open_part = open_part.where(lead == cut["_lead"])
        if left == 0:
            return drawn.where(lead < cut["_lead"]).drop("_draw")
        if cut["count"] <= _SORTABLE or digits >= _LONGEST:
            break
    place = [F.col("_draw"), F.col(key).asc_nulls_first()]
    last = open_part.orderBy(*place).limit(left).select("_draw", key).tail(1)[0] if cut["count"] <= _SORTABLE else None
    if last is not None and last[key] is not None:
        before = (F.col("_draw") < last["_draw"]) | ((F.col("_draw") == last["_draw"]) & (F.col(key) <= last[key]))
        if open_part.where(before).count() == left:
            return drawn.where(before).drop("_draw")
    straddling = open_part.orderBy(*place, F.xxhash64(*rows.columns)).limit(left)
    return union_all(drawn.where(lead < cut["_lead"]), straddling).drop("_draw")


def undersample(df: DataFrame, label: str = "is_risk", key: str = "rowkey", seed: int = 27) -> DataFrame:
    """All risk rows and as many normal rows, chosen without replacement."""
    risky = df.where(F.col(label) == 1)
    return union_all(risky, smallest_draws(df.where(F.col(label) == 0), risky.count(), key, seed))


def undersample_by_share(
    df: DataFrame, share: float, label: str = "is_risk", key: str = "rowkey", seed: int = 27
) -> DataFrame:
    """All risk rows and about this share of the normal rows: one pass, no count."""
    return df.where((F.col(label) == 1) | (draw(key, seed) < int(share * DRAWS)))


def hold_out(df: DataFrame, train_share: float = 0.8, key: str = "rowkey", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train and test part."""
    in_train = draw(key, seed) < int(train_share * DRAWS)
    return df.where(in_train), df.where(~in_train)


def with_folds(df: DataFrame, k: int, key: str = "rowkey", seed: int = 27, name: str = "fold") -> DataFrame:
    """Number the rows 0 .. k-1 for cross-validation."""
    return df.withColumn(name, F.pmod(draw(key, seed), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, k: int, label: str = "is_risk", key: str = "rowkey", seed: int = 27, name: str = "fold") -> DataFrame:
    """Number the rows 0 .. k-1 so that the folds' shares of each class differ by one row at most.

    The rows of a class are dealt in turn, in order of their draws.
    """
    placed = numbered(df.withColumn("_draw", draw_text(key, seed)), [label], ["_draw", key], "_place")
    return placed.withColumn(name, F.pmod("_place", F.lit(k)).cast("int")).drop("_draw", "_place")


def hold_out_exact(df: DataFrame, train_share: float = 0.8, key: str = "rowkey", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train and test part, the train part the whole number of rows at or below the share."""
    placed = numbered(df.withColumn("_draw", draw_text(key, seed)), [], ["_draw", key], "_place")
    n = whole_part(F.lit(df.count()), train_share)
    return tuple(placed.where(part).drop("_draw", "_place") for part in (F.col("_place") < n, F.col("_place") >= n))


def whole_part(n: Column, share: float) -> Column:
    """floor(n * share), with the share as the decimal that it is written as (0.7 of 10 is 7)."""
    return F.floor(n.cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("long")


def with_train_places(folded: DataFrame, k: int, key: str = "rowkey", seed: int = 28) -> DataFrame:
    """Rows in folds with `place_0` .. `place_<k-1>`: the row's place, from 1, in the training part that leaves that fold out.

    Places follow one order of draws, so the samples of any size cut from them are nested. All are counted in one pass
    over that order; in its own fold a row has the place of the row before it.
    """
    counted = folded.withColumns({f"_in_{j}": (F.col("fold") == j).cast("long") for j in range(k)})
    counted = counted.withColumn("_draw", draw_text(key, seed))
    counted = running_total(counted, [], ["_draw", key], {f"_seen_{j}": f"_in_{j}" for j in range(k)})
    places = {f"place_{i}": sum((F.col(f"_seen_{j}") for j in range(k) if j != i), F.lit(0)) for i in range(k)}
    return counted.withColumns(places).drop("_draw", *[f"_{what}_{j}" for what in ("in", "seen") for j in range(k)])


def random_labels(df: DataFrame, key: str = "rowkey", seed: int = 27, name: str = "r") -> DataFrame:
    """A coin toss per row: the baseline to beat."""
    return df.select(key, (draw(key, seed) >= DRAWS // 2).cast("int").alias(name))
