"""Running sums and row numbers over a total order without a one-task window.

A window without a partition key moves all rows to one task, and a window keyed
by a hot group does the same to that group. Here the order is cut into nested
slices by value (for example ``time >> 24``, ``time >> 12``): sums per slice are
aggregated first, turned into offsets, and added to a window that only ever sees
one finest slice. Every window is as long as the number of child slices of one
parent, or the rows of one finest slice.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def int_slices(column: str | Column, *shifts: int) -> list[Column]:
    """Nested slices of a non-negative integer column, coarse to fine."""
    col = F.col(column) if isinstance(column, str) else column
    return [F.shiftright(col, shift) for shift in shifts]


def text_slices(column: str, *lengths: int) -> list[Column]:
    """Nested slices of a string column by prefix, in string order."""
    return [F.substring(F.col(column), 1, n) for n in lengths]


def spread_slices(df: DataFrame, column: str, *lengths: int) -> list[Column]:
    """Nested slices of a string column by the characters behind the prefix that all its values share.

    The prefix is that of the least and the greatest value, the only two that reach the driver.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]))
    return text_slices(column, *[shared + n for n in lengths])


def time_slices(column: str = "time") -> list[Column]:
    return int_slices(column, 24, 12)


def arrival_slices(column: str = "seq") -> list[Column]:
    """Slices of a unique arrival number: at most 65,536 rows in the finest."""
    return int_slices(column, 32, 16)


def slice_offsets(sums: DataFrame, by: Sequence[str], levels: Sequence[str], value: str) -> DataFrame:
    """Sum of ``value`` over all earlier slices of the same group.

    ``sums`` has one row per (by, levels). Returns (by, levels, _offset).
    """
    out = None
    for depth in range(len(levels), 0, -1):
        parents, level = [*by, *levels[: depth - 1]], levels[depth - 1]
        keys = [*parents, level]
        at_depth = sums if depth == len(levels) else sums.groupBy(*keys).agg(F.sum(value).alias(value))
        earlier = Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum(value).over(earlier), F.lit(0))
        at_depth = at_depth.select(*keys, offset.alias(f"_before{depth}"))
        out = at_depth if out is None else out.join(at_depth, keys)
    total = sum((F.col(f"_before{d}") for d in range(2, len(levels) + 1)), F.col("_before1"))
    return out.select(*by, *levels, total.alias("_offset"))


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    slices: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "running",
) -> DataFrame:
    """Adds the inclusive running sum of ``value`` in ``order`` within ``by``.

    ``slices`` are non-null and follow the order: a row in an earlier slice
    precedes every row of a later one.
    """
    levels = [f"_slice{i}" for i in range(len(slices))]
    sliced = df.select("*", *[c.alias(n) for c, n in zip(slices, levels)], value.alias("_value"))
    keys = [*by, *levels]
    sums = sliced.groupBy(*keys).agg(F.sum("_value").alias("_value"))
    offsets = slice_offsets(sums, by, levels, "_value")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, keys)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop(*levels, "_value", "_inside", "_offset")
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    slices: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "row_number",
) -> DataFrame:
    """Adds a one-based row number in ``order`` within ``by``."""
    return running_sum(df, F.lit(1), order, slices, by, name)


def neighbour_value(
    df: DataFrame,
    value: Column,
    order: Column,
    slices: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "previous",
    following: bool = False,
) -> DataFrame:
    """Adds the value of the preceding (or following) row, null at a group's edge.

    The value at the border of each slice is carried to the neighbouring slice,
    so a group larger than one task's memory is still walked in pieces. ``order``
    is unique within ``by``.
    """
    levels = [f"_slice{i}" for i in range(len(slices))]
    keys = [*by, *levels]
    sliced = df.select("*", *[c.alias(n) for c, n in zip(slices, levels)])
    told = [F.struct(value.alias("v")).alias("_value"), order.alias("_order")]
    pick = F.min_by if following else F.max_by
    shift = F.lead if following else F.lag
    borders = sliced.select(*keys, *told).groupBy(*keys).agg(pick("_value", "_order").alias("_border"))
    carried = _carry_over(borders, by, levels, pick, shift)
    inside = Window.partitionBy(*keys).orderBy("_order")
    # Value and order are made behind the exchange, so that a row moves with each of its columns once.
    return (
        sliced.repartition(*keys)
        .select("*", *told)
        .withColumn("_near", shift("_value").over(inside))
        .join(carried, keys)
        .withColumn(name, F.coalesce("_near", "_carried")["v"])
        .drop(*levels, "_value", "_order", "_near", "_carried")
    )


def _carry_over(borders: DataFrame, by: Sequence[str], levels: Sequence[str], pick, shift) -> DataFrame:
    """For each slice, the border value of the nearest other slice of the group."""
    parents, level = [*by, *levels[:-1]], levels[-1]
    beside = shift("_border").over(Window.partitionBy(*parents).orderBy(level))
    here = borders.select(*by, *levels, beside.alias("_carried"))
    if len(levels) == 1:
        return here
    outer = borders.groupBy(*parents).agg(pick("_border", level).alias("_border"))
    above = _carry_over(outer, by, levels[:-1], pick, shift).withColumnRenamed("_carried", "_above")
    return here.join(above, parents).select(
        *by, *levels, F.coalesce("_carried", "_above").alias("_carried")
    )


def carry_forward(df: DataFrame, value: Column, column: str, shift: int = 12, name: str = "carried") -> DataFrame:
    """Adds the last non-null value before each row, in the order of an integer ``column`` without repeated values.

    Values are carried inside slices of 2 ** ``shift`` neighbours and from slice to slice.
    """
    rows = df.select("*", F.shiftright(column, shift).alias("_slice"), value.alias("_value"))
    before = Window.partitionBy("_slice").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(column).alias("at"), F.col("_value").alias("v"))))
    slices = rows.groupBy("_slice").agg(newest["v"].alias("_last"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_slice", F.last("_last", True).over(earlier).alias("_above"))
    return (
        rows.withColumn("_near", F.last("_value", True).over(before))
        .join(slices, "_slice")
        .withColumn(name, F.coalesce("_near", "_above"))
        .drop("_slice", "_value", "_near", "_above")
    )
