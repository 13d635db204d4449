"""Keys that hold too many rows for one task.

Grouped aggregates need nothing of this: they are combined before the shuffle. What
needs it is work that brings all rows of a key together, which is a join onto the
rows of a key, and anything ordered within a key.

A key is hot when it holds more than `spark.riskloom.hotKeyTasks` times the rows that an
average task would get (5, as for adaptive skew joins: below that the extra passes cost
more than the straggler), and at least `spark.riskloom.hotKeyRows` rows. With P shuffle
partitions there are fewer than P such keys, and cut down to the size of an average task
they make fewer than 2 P pieces; this bounds every list and every broadcast below,
whatever the table's size.

How the pieces are cut changes where rows are worked on, never the result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS_CONF = "spark.riskloom.hotKeyRows"
DEFAULT_HOT_ROWS = 1_000_000
HOT_TASKS_CONF = "spark.riskloom.hotKeyTasks"
DEFAULT_HOT_TASKS = 5.0
SAMPLES_PER_PIECE = 64
TABLE_SAMPLES_PER_PIECE = 32

LANE = "_lane"
_COPIES = "_copies"
_ROWS = "_rows"
_POINTS = "_points"
_HERE = "_here"


def known(by: list[str]) -> Column:
    """All key columns have a value."""
    return reduce(and_, [F.col(c).isNotNull() for c in by], F.lit(True))


def _limits(df: DataFrame) -> tuple[int, float, int]:
    conf = df.sparkSession.conf
    least = int(conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    return least, float(conf.get(HOT_TASKS_CONF, str(DEFAULT_HOT_TASKS))), int(conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """The hot keys of `rows` with the number of pieces each should be cut into.

    One pass over the key columns gives the counts, their total and thus the average task.
    None when no key is hot. With an empty `by` the whole table counts as one hot key, however few its rows, and none
    are counted.
    """
    least, multiple, tasks = _limits(rows)
    sizes = [T.StructField(_COPIES, T.IntegerType(), False), T.StructField(_ROWS, T.LongType(), False)]
    if not by:
        return rows.sparkSession.createDataFrame([(tasks, 0)], T.StructType(sizes)) if tasks > 1 else None
    counts = rows.where(known(by)).groupBy(*by).agg(F.count(F.lit(1)).alias(_ROWS))
    average = counts.agg(F.sum(_ROWS) / tasks).scalar()  # of the same shuffle; fewer than `tasks` keys exceed it
    found = counts.where((F.col(_ROWS) >= least) & (F.col(_ROWS) > multiple * average) & (F.col(_ROWS) > average))
    hot = [
        tuple(r[c] for c in by) + (math.ceil(r[_ROWS] / r["_average"]), r[_ROWS])
        for r in found.withColumn("_average", average).collect()
    ]
    if not hot:
        return None
    fields = [T.StructField(c, rows.schema[c].dataType, True) for c in by]
    return rows.sparkSession.createDataFrame(hot, T.StructType([*fields, *sizes]))


def attach(
    rows: DataFrame, per_key: DataFrame, by: list[str], how: str = "inner", hot: DataFrame | None | bool = True
) -> DataFrame:
    """Join a table with one row per key onto the rows of each key.

    `hot` takes the result of `hot_keys(rows, by)`; True works it out here. The rows
    of a hot key are dealt out over its pieces, and the key's one row is copied to
    each. The rows are dealt by their content, so a re-run task deals them alike. In a left
    join rows without key, which match nothing, are dealt over all tasks as well.
    """
    if hot is True:
        hot = hot_keys(rows, by)
    if hot is None:
        return rows.join(per_key, by, how)
    hot = F.broadcast(hot.drop(_ROWS))
    pieces = F.coalesce(F.col(_COPIES), F.when(~known(by), F.lit(_limits(rows)[2])))
    dealt = F.pmod(F.xxhash64(*rows.columns), pieces).cast("int")
    left = rows.join(hot, by, "left").withColumn(LANE, F.coalesce(dealt, F.lit(0))).drop(_COPIES)
    lanes = F.sequence(F.lit(0), F.coalesce(F.col(_COPIES), F.lit(1)) - 1)
    right = per_key.join(hot, by, "left").withColumn(LANE, F.explode(lanes)).drop(_COPIES)
    return left.join(right, [*by, LANE], how).drop(LANE)


def with_group_values(
    rows: DataFrame, by: list[str], values: dict[str, Column], hot: DataFrame | None | bool = True
) -> DataFrame:
    """Add aggregates over each key to every row of the key; rows without a key go.

    Without hot keys this is a window, which shares the shuffle with the other work
    on that key. With hot keys it is an aggregate, combined before its shuffle, that
    is attached to the rows.
    """
    if hot is True:
        hot = hot_keys(rows, by)
    rows = rows.where(known(by))
    if hot is None:
        w = Window.partitionBy(*by)
        return rows.withColumns({name: agg.over(w) for name, agg in values.items()})
    per_key = rows.groupBy(*by).agg(*[agg.alias(name) for name, agg in values.items()])
    return attach(rows, per_key, by, "inner", hot)


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _cut_points(rows: DataFrame, by: list[str], order: list[str], hot: DataFrame) -> DataFrame:
    """Where to cut the hot keys, read off a sample of bounded size."""
    spark = rows.sparkSession
    found = hot.collect()
    pieces, n = sum(r[_COPIES] for r in found), sum(r[_ROWS] for r in found)
    keyed = rows.select(*dict.fromkeys([*by, *order])).dropna(subset=order)
    if by:
        sample = keyed.join(F.broadcast(hot), by).sample(min(1.0, SAMPLES_PER_PIECE * pieces / n), seed=1)
    else:  # those of smallest hash: so many, whatever the table's size
        sample = keyed.orderBy(F.xxhash64(*order)).limit(TABLE_SAMPLES_PER_PIECE * pieces).withColumn(_COPIES, F.lit(pieces))
    picked = (
        sample.groupBy(*by)
        .agg(F.sort_array(F.collect_list(_order(order))).alias("_s"), F.first(_COPIES).alias(_COPIES))
        .select(
            *by,
            F.transform(
                F.sequence(F.lit(1), F.col(_COPIES) - 1),
                lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col(_COPIES)).cast("int")),
            ).alias(_POINTS),
        )
    )
    # Collected, so that all later passes cut at the same places: fewer than 2 P values.
    return spark.createDataFrame(picked.collect(), picked.schema)


def with_lanes(
    rows: DataFrame, by: list[str], order: list[str], hot: DataFrame | None | bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Cut hot keys into consecutive runs: a `_lane` number that never falls along `order`.

    Rows with equal `order` share a lane. Ordinary keys are all lane 0. Returns the
    rows and the hot keys; both unchanged, and no lane column, when there are none.
    """
    if hot is True:
        hot = hot_keys(rows, by)
    if hot is None:
        return rows, None
    points = _cut_points(rows, by, order, hot)
    longest = max((len(r[_POINTS] or ()) for r in points.collect()), default=0)
    strides = [1 << b for b in range(max(longest, 1).bit_length() - 1, -1, -1)]
    if by:
        rows = rows.join(F.broadcast(points), by, "left")
    else:
        rows = rows.withColumn(_POINTS, points.select(_POINTS).scalar())
    # Binary search for the last cut at or before the row, one column per step: unlike a
    # lambda over the array, this is compiled, and it does not copy the array about.
    rows = rows.withColumns({LANE: F.lit(0), _HERE: _order(order)})
    for step in strides:
        beyond = F.get(_POINTS, F.col(LANE) + (step - 1)) <= F.col(_HERE)
        rows = rows.withColumn(LANE, F.when(beyond, F.col(LANE) + step).otherwise(F.col(LANE)))
    return rows.drop(_POINTS, _HERE), points


def only_hot(laned: DataFrame, by: list[str], points: DataFrame) -> DataFrame:
    """The rows of the hot keys."""
    return laned.join(F.broadcast(points.select(*by)), by, "left_semi") if by else laned
