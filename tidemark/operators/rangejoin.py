"""Joins on intervals without a nested loop: both sides are cut into bins, joined on the bin, and refined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int, touching: bool = False) -> DataFrame:
    """Rows of left and right with equal on-columns whose ranges [start, end) overlap; each pair once.

    touching: a left range that ends exactly where a right one starts overlaps it too. The columns of both sides must have different
    names apart from on. Pairs are found in the first bin that both ranges share.
    """
    (ls, le), (rs, re) = left_range, right_range
    last = F.col(le) if touching else F.greatest(F.col(le) - 1, F.col(ls))
    a = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col(ls), bin_size), _bin(last, bin_size))))
    b = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col(rs), bin_size), _bin(F.greatest(F.col(re) - 1, F.col(rs)), bin_size))))
    meets = (F.col(ls) < F.col(re)) & ((F.col(le) >= F.col(rs)) if touching else (F.col(le) > F.col(rs)))
    first = F.col("_bin") == F.greatest(_bin(F.col(ls), bin_size), _bin(F.col(rs), bin_size))
    return a.join(b, [*on, "_bin"]).where(meets & first).drop("_bin")


def point_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, bounds: tuple[str, str], bin_size: int) -> DataFrame:
    """Rows of points with the row of ranges [start, end) that holds point."""
    start, end = bounds
    a = points.withColumn("_bin", _bin(F.col(point), bin_size))
    b = ranges.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), bin_size), _bin(F.greatest(F.col(end) - 1, F.col(start)), bin_size))))
    return a.join(b, [*on, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the latest row of right at or before left_time, for equal on-columns: one union and one window."""
    both = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v")).unionByName(
        right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(value).alias("_v")), allowMissingColumns=True)
    from pyspark.sql import Window

    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)[value]).where("_side = 1").drop("_t", "_side", "_v")
