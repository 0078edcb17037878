"""Mini-batches by distinct time points and by row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import END_OF_TIME
from tidemark.operators import ordering


def rank_times(points: DataFrame, origin: int = 0) -> DataFrame:
    """Distinct time points with their rank; ``origin`` itself has rank 0.

    Only distinct times are shuffled. Returns (time, lines, rank), ``lines``
    being the number of rows at that time.
    """
    times = points.where(F.col("time") >= origin).groupBy("time").agg(F.count("*").alias("lines"))
    after_origin = (F.col("time") > origin).cast("bigint")
    return ordering.running_sum(
        times, after_origin, ["time"], ordering.time_slices(), name="rank"
    )


def early_points(points: DataFrame, origin: int = 0) -> DataFrame:
    """The points that ``rank_times`` leaves out: before ``origin``, where the first batch starts, or without a time."""
    return points.where(F.coalesce(F.col("time") < origin, F.lit(True)))


def batch_times(
    ranked: DataFrame, size: int, first_batch: int = 0, drop_dangling_tail: bool = False
) -> DataFrame:
    """Gives each distinct time its batch: every ``size`` ranks open a new one.

    Returns (time, batch_id, opens, lost, lines). ``lost`` marks the time of a single
    last line that opens a batch on its own, when such a tail is to be dropped;
    that time then closes the batch before it.
    """
    batch_id = F.lit(first_batch) + F.floor(F.col("rank") / size)
    opens = (F.col("rank") % size == 0) & (F.col("rank") > 0)
    lost = F.lit(False)
    if drop_dangling_tail:
        last = ranked.agg(F.max("rank")).scalar()
        lost = opens & (F.col("rank") == last) & (F.col("lines") == 1)
    return ranked.select("time", batch_id.alias("id"), opens.alias("opens"), lost.alias("lost"), "lines").select(
        "time",
        F.when(F.col("lost"), F.col("id") - 1).otherwise(F.col("id")).alias("batch_id"),
        (F.col("opens") & ~F.col("lost")).alias("opens"),
        "lost",
        "lines",
    )


def batch_bounds(
    times: DataFrame, first_batch: int = 0, origin: int = 0, end_of_time: int = END_OF_TIME
) -> DataFrame:
    """One row per batch: start, end, first and last event time, distinct times.

    A batch starts where it opens (the first one at ``origin``) and ends where
    the next one starts, the last one at ``end_of_time`` or, if its events reach
    that far, behind the last of them. The end is found by
    sending each opening time to the batch before it, so no ordered window over
    all batches is needed.
    """
    bigint = F.lit(None).cast("bigint")
    inside = F.struct(F.col("batch_id"), F.col("time").alias("own"), bigint.alias("following"))
    closing = F.struct((F.col("batch_id") - 1).alias("batch_id"), bigint.alias("own"), F.col("time").alias("following"))
    rows = times.select(
        F.explode(F.when(F.col("opens"), F.array(inside, closing)).otherwise(F.array(inside))).alias("r")
    ).select("r.*")
    return rows.groupBy("batch_id").agg(
        F.when(F.col("batch_id") == first_batch, F.lit(origin).cast("bigint"))
        .otherwise(F.min("own"))
        .alias("batch_start"),
        F.coalesce(F.min("following"), F.greatest(F.lit(end_of_time).cast("bigint"), F.max("own") + 1)).alias("batch_end"),
        F.min("own").alias("first_time"),
        F.max("own").alias("last_time"),
        F.count("own").alias("n_times"),
    )


def batch_slots(times: DataFrame, bounds: DataFrame, size: int) -> DataFrame:
    """Lookup from time to batch: (slot, batch_id, batch_start, low, high).

    The slot is time / size. A batch of ``size`` whole-second times lasts at
    least ``size`` seconds, so a slot meets at most two batches, and the table
    is about ``size / 2`` times smaller than the table of times.
    """
    return (
        times.where(~F.col("lost"))
        .groupBy(_slot(size).alias("slot"), "batch_id")
        .agg(F.min("time").alias("low"), F.max("time").alias("high"))
        .join(bounds.select("batch_id", "batch_start"), "batch_id")
    )


def attach_batch(points: DataFrame, slots: DataFrame, size: int) -> DataFrame:
    """Adds ``batch_id`` and ``batch_start`` to every point that belongs to a batch.

    An equality join on the slot with a range check: a broadcast join while the
    measured slot table is small, else a sort-merge join whose hot slots
    adaptive execution splits.
    """
    near = points.withColumn("slot", _slot(size))
    inside = (near["slot"] == slots["slot"]) & near["time"].between(slots["low"], slots["high"])
    return near.join(slots, inside).select(
        *[near[c] for c in points.columns], slots["batch_id"], slots["batch_start"]
    )


def _slot(size: int) -> Column:
    return F.floor(F.col("time") / size)


def batch_by_times(points: DataFrame, size: int, drop_dangling_tail: bool = False) -> DataFrame:
    """Points with their batch of ``size`` distinct time points."""
    times = batch_times(rank_times(points), size, drop_dangling_tail=drop_dangling_tail)
    return attach_batch(points, batch_slots(times, batch_bounds(times), size), size)


def batch_event_types(batched: DataFrame) -> DataFrame:
    """Sorted distinct event types of each batch."""
    return batched.groupBy("batch_id").agg(F.sort_array(F.collect_set("lle")).alias("event_types"))


def batch_by_rows(
    df: DataFrame,
    size: int,
    order: Sequence[str],
    slices: Sequence[Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Fixed-size batches by row count in ``order``; the last one may be short."""
    numbered = ordering.number_rows(df, order, slices, by, "_row")
    return numbered.withColumn("batch_id", F.floor((F.col("_row") - 1) / size)).drop("_row")
