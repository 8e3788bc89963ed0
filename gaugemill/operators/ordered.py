"""Order-dependent columns inside groups of any size.

A plain ``partitionBy(key)`` window puts a whole group into one task. Here rows are dealt out by ranges of
(group columns, order columns), so that any group may be cut at any place, windows run within a range, and a table
with one row per group and range carries values across the cuts. There is one path for groups of every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.session import stage

#: Rows a range is meant to hold; the number of ranges follows from the row count.
RANGE_ROWS = 1_000_000
_RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_range``, the number of the range of ``keys`` a row is in; later ranges hold later keys.

    The rows are written once, so that every use of them sees the same ranges.
    """
    ranges = max(1, -(-df.count() // range_rows))
    return stage(df.repartitionByRange(ranges, *keys).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, carried: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per-range values next to the rows; groups are compared null-safely, so a null group is one like any other."""
    renamed = carried.select(*[F.col(k).alias(f"_of_{k}") for k in [*groups, _RANGE]], *values)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in groups] + [F.col(_RANGE) == F.col(f"_of_{_RANGE}")]
    return rows.join(renamed, reduce(Column.__and__, same)).drop(*[f"_of_{k}" for k in [*groups, _RANGE]])


def _ranges_of(groups: Sequence[str]):
    """Window over the table of ranges: a group has one row for each RANGE_ROWS of all rows at most."""
    return Window.partitionBy(*groups).orderBy(_RANGE)


def running_totals(
    df: DataFrame,
    order: str,
    totals: Mapping[str, str],
    groups: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Cumulative sums of the ``totals`` source columns up to and including each row.

    ``order`` must be unique within a group. ``all_<name>`` is the group's grand total.
    """
    rows = in_ranges(df, [*groups, order], range_rows)
    earlier = _ranges_of(groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*groups, _RANGE)
        .agg(*[F.sum(source).alias(f"_o_{name}") for name, source in totals.items()])
        .select(
            *groups, _RANGE,
            *[F.coalesce(F.sum(f"_o_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in totals],
            *[F.sum(f"_o_{name}").over(Window.partitionBy(*groups)).alias(f"all_{name}") for name in totals],
        )
    )
    local = Window.partitionBy(*groups, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(source).over(local).alias(name) for name, source in totals.items()])
    return _joined(summed, offsets, groups, [f"{p}{name}" for name in totals for p in ("_b_", "all_")]).select(
        *df.columns,
        *[(F.col(name) + F.col(f"_b_{name}")).alias(name) for name in totals],
        *[f"all_{name}" for name in totals],
    )


def with_row_number(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """1-based position inside each group, ordered by ``order``; rows equal in all of it come in any order."""
    rows = in_ranges(df, [*groups, *order], range_rows)
    offsets = (
        rows.groupBy(*groups, _RANGE)
        .agg(F.count("*").alias("_n"))
        .select(*groups, _RANGE, F.coalesce(
            F.sum("_n").over(_ranges_of(groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*groups, _RANGE).orderBy(*order)
    numbered = rows.withColumn("_local", F.row_number().over(local))
    return _joined(numbered, offsets, groups, ["_before"]).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def with_previous(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], previous: Mapping[str, str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Columns of the preceding row of the group: ``{new name: source column}``."""
    rows = in_ranges(df, [*groups, *order], range_rows)
    values = F.struct(*[F.col(source).alias(name) for name, source in previous.items()])
    carried = (
        rows.groupBy(*groups, _RANGE)
        .agg(F.max_by(values, F.struct(*order)).alias("_last"))
        .select(*groups, _RANGE, F.lag("_last").over(_ranges_of(groups)).alias("_carried"))
    )
    lagged = rows.withColumn("_lagged", F.lag(values).over(Window.partitionBy(*groups, _RANGE).orderBy(*order)))
    chosen = F.coalesce(F.col("_lagged"), F.col("_carried"))
    return _joined(lagged, carried, groups, ["_carried"]).select(*df.columns, *[chosen[name].alias(name) for name in previous])
