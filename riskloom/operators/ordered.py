"""Work along the time order of each key: previous row, gaps, running totals.

`order` must end in a column that makes it unique within a key, as times repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clock
from riskloom.operators.hotkeys import LANE, known, only_hot, with_lanes
from riskloom.session import freeze

_PREVIOUS = "_previous"
_CARRY = "_carry"
_AT = "_at_row"
_RANGE = "_range"
_FROM = "_from_row"
_PLACES = (1 << 33) - 1  # bits of a generated id that count within a partition


def with_previous(
    rows: DataFrame, by: list[str], order: list[str], columns: dict[str, str], hot: DataFrame | None | bool = True
) -> DataFrame:
    """Add columns of the row before: `columns` maps each new name to the column it reads.

    NULL on a key's first row. Rows without a key are left out. Hot keys are worked on
    lane by lane, and a lane's first row takes the last row of the lane before. With an empty `by` the lanes of the
    whole table are written once, and read again with what the lanes before them end in.
    """
    rows = rows.where(known(by))
    laned, points = with_lanes(rows, by, order, hot)
    if points is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
    values = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    along = Window.partitionBy(*by, LANE).orderBy(*order)
    if not by:
        laned = freeze(laned.withColumn(_PREVIOUS, F.lag(values).over(along)), "lanes")
    ends = (
        only_hot(laned, by, points)
        .groupBy(*by, LANE)
        .agg(F.max_by(values, F.struct(*[F.col(c) for c in order])).alias("_end"))
        .withColumn(_CARRY, F.lag("_end").over(Window.partitionBy(*by).orderBy(LANE)))
        .drop("_end")
    )
    before = F.coalesce(_PREVIOUS, _CARRY)
    return (
        (laned.withColumn(_PREVIOUS, F.lag(values).over(along)) if by else laned)
        .join(F.broadcast(ends), [*by, LANE], "left")
        .withColumns({new: before[new] for new in columns})
        .drop(_PREVIOUS, _CARRY, LANE)
    )


def with_gap(
    rows: DataFrame, by: list[str], time: str, tie: str, name: str, hot: DataFrame | None | bool = True
) -> DataFrame:
    """Add the gap to the key's previous row, in microseconds."""
    return (
        with_previous(rows, by, [time, tie], {"_before": time}, hot)
        .withColumn(name, clock.gap_us("_before", time))
        .drop("_before")
    )


def with_gap_parts(
    rows: DataFrame,
    by: list[str],
    time: str,
    tie: str,
    days: str | None = None,
    seconds: str | None = None,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Add the gap to the key's previous row as whole days and as seconds within the day."""
    rows = with_gap(rows, by, time, tie, "_gap", hot)
    parts = {}
    if days:
        parts[days] = clock.gap_days("_gap")
    if seconds:
        parts[seconds] = clock.gap_seconds("_gap")
    return rows.withColumns(parts).drop("_gap")


def difference(
    rows: DataFrame, by: list[str], order: list[str], columns: list[str], hot: DataFrame | None | bool = True
) -> DataFrame:
    """Each named column less its value in the row before, as `<column>_diff`.

    Times give microseconds. With an empty `by` the whole table is one sequence.
    """
    before = {f"_before_{c}": c for c in columns}
    out = with_previous(rows, by, order, before, hot)
    kinds = dict(rows.dtypes)

    def step(c: str):
        if kinds[c].startswith(("timestamp", "date")):
            return clock.gap_us(f"_before_{c}", c)
        return F.col(c) - F.col(f"_before_{c}")

    return out.withColumns({f"{c}_diff": step(c) for c in columns}).drop(*before)


def running_total(
    rows: DataFrame,
    by: list[str],
    order: list[str],
    columns: dict[str, str],
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Add sums over the rows so far: `columns` maps each new name to the column summed.

    With an empty `by` the whole table is one sequence: its rows are dealt into ranges of `order`, summed up within
    them and written once; the ranges' own sums, read off what was written, tell what to add to each. So there is one
    shuffle of the rows and one reading of the input, besides a sample of `order` to cut the ranges by.
    """
    rows = rows.where(known(by))
    laned, points = with_lanes(rows, by, order, hot)

    def so_far(keys: list[str]):
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    if points is None:
        return rows.withColumns({new: F.sum(old).over(so_far(by)) for new, old in columns.items()})
    here = {f"_here_{new}": F.sum(old).over(so_far([*by, LANE])) for new, old in columns.items()}
    if not by:
        laned = freeze(laned.withColumns(here), "lanes")
    offsets = only_hot(laned, by, points).groupBy(*by, LANE).agg(
        *[F.sum(old).alias(f"_sum_{new}") for new, old in columns.items()]
    )
    earlier = Window.partitionBy(*by).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *by, LANE, *[F.sum(f"_sum_{new}").over(earlier).alias(f"_from_{new}") for new in columns]
    )
    out = (laned.withColumns(here) if by else laned).join(F.broadcast(offsets), [*by, LANE], "left")

    def total(new: str):
        here, before = F.col(f"_here_{new}"), F.col(f"_from_{new}")
        return F.coalesce(here + before, here, before)

    drop = [f"_{k}_{new}" for k in ("here", "from") for new in columns]
    return out.withColumns({new: total(new) for new in columns}).drop(*drop, LANE)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Add the place of each row within its key along `order`, from 0; rows without a key form groups of their own.

    The rows are written once, cut into ranges of [*by, *order] and sorted: a row's place within its range comes
    with the writing, and one small table of the ranges' sizes tells what stands before each. So neither the whole
    table nor a large key is ordered in one task, and a hot key simply covers several ranges. Rows equal in all of
    `order` share a range and stand in any order, so end it in something unique. Cutting the ranges samples `rows`, a pass of its own.
    """
    keys = [*by, *order]
    placed = rows.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    placed = freeze(placed.withColumn(_AT, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(_RANGE, F.shiftright(_AT, 33))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(_RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_FROM))
    place = F.col(_FROM) + F.col(_AT).bitwiseAND(F.lit(_PLACES))
    out = placed.join(F.broadcast(sizes), _RANGE).withColumn(name, place).drop(_RANGE, _AT, _FROM)
    if not by:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_key_{c}") for c in by]).agg(F.min(name).alias(_FROM))
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    return out.join(first, same).withColumn(name, F.col(name) - F.col(_FROM)).drop(_FROM, *[f"_key_{c}" for c in by])
