"""Joins of interval events with mini-batches and with time points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordering

_BATCH_COLUMNS = ("batch_id", "batch_start", "batch_end")
_TIME_RUN = 4096


def _bucket(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width))


def batch_directory(bounds: DataFrame, buckets: DataFrame, bucket_seconds: int = 4096) -> DataFrame:
    """For each time bucket the batches it meets, by start: (bucket, batches).

    Batches follow each other without gaps, so a bucket meets those that start in it and the one that is open when it
    begins. Rows are the buckets in which batches start and those of ``buckets``; the open batch is carried forward over
    these rows, so gaps and the open end cost nothing however long they are. At most ``bucket_seconds`` batches start in one.
    """
    started = F.struct(*[F.col(c) for c in ("batch_start", "batch_end", "batch_id")])
    own = bounds.groupBy(_bucket(F.col("batch_start"), bucket_seconds).alias("bucket")).agg(
        F.sort_array(F.collect_list(started)).alias("own")
    )
    every = own.unionByName(buckets.select("bucket").distinct(), allowMissingColumns=True)
    every = every.groupBy("bucket").agg(F.max("own").alias("own"))
    carried = ordering.carry_forward(every, F.element_at("own", -1), "bucket", name="open")
    known = F.filter(F.concat(F.array("open"), F.coalesce("own", F.array())), lambda b: b.isNotNull())
    return carried.select("bucket", known.alias("batches"))


def _newest(batches: Column, at: Column) -> Column:
    """The last of the listed batches that does not start behind a time."""
    return F.try_element_at(F.filter(batches, lambda b: b["batch_start"] <= at), F.lit(-1))


def locate_ends(intervals: DataFrame, bounds: DataFrame, bucket_seconds: int = 4096) -> DataFrame:
    """Adds ``first`` and ``last``: the last batches that start not later than ``stime`` and ``etime``, null before all.

    Both ends are looked up with one equality key each in a table of about one row per time bucket that the intervals
    touch; the intervals themselves are moved once at most, and a bucket with many of them can be split.
    """
    ends = {"first": "stime", "last": "etime"}
    touched = intervals.select(F.explode(F.array(*[_bucket(F.col(c), bucket_seconds) for c in ends.values()])).alias("bucket"))
    directory = batch_directory(bounds, touched, bucket_seconds)
    out = intervals
    for name, column in ends.items():
        key, listed = f"_{name}_bucket", f"_{name}_batches"
        there = directory.select(F.col("bucket").alias(key), F.col("batches").alias(listed))
        out = out.withColumn(key, _bucket(F.col(column), bucket_seconds)).join(there, key, "left")
        out = out.withColumn(name, _newest(F.col(listed), F.col(column))).drop(key, listed)
    return out


def overlap_spans(located: DataFrame, bounds: DataFrame, closed: bool = False) -> DataFrame:
    """The intervals with located ends that overlap a batch, with the first and last number of these: (begin, end).

    With ``closed`` an interval that only touches a batch boundary counts.
    """
    lowest = bounds.agg(F.min("batch_id")).scalar()
    first, last = F.col("first"), F.col("last")
    begin = F.coalesce(first["batch_id"], lowest)
    if closed:
        begin = begin - F.when((F.col("stime") == first["batch_start"]) & (begin > lowest), 1).otherwise(0)
        reaches = first.isNull() | (F.col("stime") <= first["batch_end"])
        end = last["batch_id"]
    else:
        reaches = first.isNull() | (F.col("stime") < first["batch_end"])
        end = last["batch_id"] - F.when(F.col("etime") == last["batch_start"], 1).otherwise(0)
    spans = located.where(reaches).withColumns({"begin": begin, "end": end})
    return spans.where(F.col("begin") <= F.col("end")).drop("first", "last")


def overlaps(located: DataFrame, bounds: DataFrame, closed: bool = False) -> DataFrame:
    """One row per interval with located ends and batch it overlaps, by batch-id range: no comparison with every batch."""
    spans = overlap_spans(located, bounds, closed)
    return spans.withColumn("batch_id", F.explode(F.sequence("begin", "end"))).drop("begin", "end")


def overlap_join(
    intervals: DataFrame,
    bounds: DataFrame,
    closed: bool = False,
    bucket_seconds: int = 4096,
) -> DataFrame:
    """One row per interval and batch it overlaps. Both ends are looked up once, the batches between them are listed."""
    return overlaps(locate_ends(intervals, bounds, bucket_seconds), bounds, closed)


def edges_of(located: DataFrame) -> DataFrame:
    """Start and end of every interval with located ends, with the batch each of them falls into."""
    edge = F.explode(
        F.array(
            F.struct(F.lit("start").alias("edge"), F.col("stime").alias("at"), F.col("first").alias("batch")),
            F.struct(F.lit("end").alias("edge"), F.col("etime").alias("at"), F.col("last").alias("batch")),
        )
    )
    others = [c for c in located.columns if c not in ("first", "last")]
    edges = located.withColumn("_edge", edge).where(F.col("_edge.at") < F.col("_edge.batch.batch_end"))
    return edges.select(*others, "_edge.edge", "_edge.at", *[F.col(f"_edge.batch.{c}").alias(c) for c in _BATCH_COLUMNS])


def interval_edges(intervals: DataFrame, bounds: DataFrame, bucket_seconds: int = 4096) -> DataFrame:
    """Start and end of every interval with the batch each of them falls into."""
    return edges_of(locate_ends(intervals, bounds, bucket_seconds))


def start_edges(edges: DataFrame, bounds: DataFrame, closed: bool = False) -> DataFrame:
    """Interval starts inside an overlapped batch.

    A start lies in one batch only, except that with ``closed`` a start on a
    boundary also belongs to the batch that ends there.
    """
    starts = edges.where(F.col("edge") == "start")
    if not closed:
        return starts.where(F.col("etime") > F.col("batch_start"))
    before = bounds.select(*_BATCH_COLUMNS)
    touching = (
        starts.where((F.col("at") == F.col("batch_start")) & (F.col("batch_id") > 0))
        .withColumn("batch_id", F.col("batch_id") - 1)
        .drop("batch_start", "batch_end")
        .join(before, "batch_id")
    )
    return starts.unionByName(touching).where(F.col("etime") >= F.col("batch_start"))


def last_inner_times(
    bounds: DataFrame, starts: DataFrame, point_events: Sequence[str]
) -> DataFrame:
    """Second-largest time point of each batch: (batch_id, inner_last).

    The largest one is always the batch end, so a plain maximum over the others
    (batch start, event times, starts of point-like intervals) is enough.
    """
    own = bounds.select("batch_id", F.greatest("batch_start", "last_time").alias("time"))
    added = starts.where(
        F.col("hle").isin(*point_events) & (F.col("stime") < F.col("batch_end"))
    ).select("batch_id", F.col("stime").alias("time"))
    return own.unionByName(added).groupBy("batch_id").agg(F.max("time").alias("inner_last"))


def end_edges(edges: DataFrame, inner_last: DataFrame, closed: bool = False) -> DataFrame:
    """Interval ends not later than the second-largest time point of their batch."""
    ends = edges.where(F.col("edge") == "end")
    since = F.col("etime") >= F.col("batch_start") if closed else F.col("etime") > F.col("batch_start")
    return (
        ends.where(since & (F.col("stime") < F.col("batch_end")))
        .join(inner_last, "batch_id")
        .where(F.col("etime") <= F.col("inner_last"))
        .drop("inner_last")
    )


def inner_times(times: Column, stime: Column, etime: Column) -> Column:
    """Those of the listed times that lie strictly between two others."""
    return F.filter(times, lambda t: (stime < t) & (t < etime))


def _met_runs(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """The pairs by runs of time points that they reach into, with the times they strictly contain there as ``_inside``.

    A batch's time points are listed in runs of one time slice; two numbers of each are compared with a pair, and times are
    compared only in a run that the pair does not cover. Times in a pair's list ``noisy``, where there is one, are left out.
    """
    runs = times.groupBy("batch_id", "batch_start", _bucket(F.col("time"), _TIME_RUN).alias("_run")).agg(
        F.sort_array(F.collect_list("time")).alias("_times"), F.min("time").alias("_low"), F.max("time").alias("_high")
    )
    stime, etime = F.col("stime"), F.col("etime")
    covered = (stime < F.col("_low")) & (F.col("_high") < etime)
    inside = F.when(covered, F.col("_times")).otherwise(inner_times(F.col("_times"), stime, etime))
    if "noisy" in pairs.columns:
        inside = F.when(F.size("noisy") > 0, F.array_except(inside, F.col("noisy"))).otherwise(inside)
    met = pairs.join(runs, "batch_id").where((stime < F.col("_high")) & (F.col("_low") < etime))
    return met.withColumn("_inside", inside).drop("_run", "_times", "_low", "_high")


def contained_times(pairs: DataFrame, times: DataFrame, told: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """One row per (batch, interval) pair and time point of the batch that the interval strictly contains.

    ``pairs`` has batch_id, stime and etime, ``times`` batch_id, batch_start and time. The contained times come out of lists
    (``_met_runs``). Columns of ``pairs`` but ``noisy``, with batch_start and ``time``. ``told`` may change the pairs behind
    the join, before there is a row per time; it keeps batch_start and ``_inside``.
    """
    return told(_met_runs(pairs, times).drop("noisy")).withColumn("time", F.explode("_inside")).drop("_inside")


def contained_counts(pairs: DataFrame, times: DataFrame, by: Sequence[str]) -> DataFrame:
    """(batch_id, by, n): how many rows ``contained_times`` has, without making them.

    Pairs with the same ends are counted before they meet the time points.
    """
    ends = [c for c in ("stime", "etime", "noisy") if c in pairs.columns]
    spans = pairs.groupBy("batch_id", *by, *ends).agg(F.count("*").alias("_pairs"))
    found = _met_runs(spans, times).select("batch_id", *by, (F.col("_pairs") * F.size("_inside")).alias("n"))
    return found.groupBy("batch_id", *by).agg(F.sum("n").alias("n"))


def contain_join(
    points: DataFrame,
    intervals: DataFrame,
    bucket_seconds: int = 4096,
    mark: Callable[[DataFrame, Callable[[Column], Column]], DataFrame] | None = None,
) -> DataFrame:
    """Points joined with the intervals that strictly contain their ``time``.

    Each interval is listed under the time buckets it reaches into and each
    point has one bucket, so the join has an equality key and no duplicates.
    Intervals are listed only between the first and the last point, so one with
    an open end is not listed up to the end of time. ``mark`` may add columns to the listed intervals, which have their
    ``_bucket``, before the join multiplies them; it also gets the function from a time to its bucket.
    """
    within = points.agg(F.struct(F.min("time").alias("low"), F.max("time").alias("high"))).scalar()
    first = F.greatest(F.col("stime") + 1, within["low"])
    last = F.least(F.col("etime") - 1, within["high"])
    met = (F.col("stime") < within["high"]) & (F.col("etime") > within["low"]) & (F.col("stime") + 1 < F.col("etime"))
    listed = intervals.where(met & (first <= last)).withColumn(
        "_bucket", F.explode(F.sequence(_bucket(first, bucket_seconds), _bucket(last, bucket_seconds)))
    )
    if mark is not None:
        listed = mark(listed, lambda time: _bucket(time, bucket_seconds))
    placed = points.withColumn("_bucket", _bucket(F.col("time"), bucket_seconds))
    return (
        placed.join(listed, "_bucket")
        .where((F.col("stime") < F.col("time")) & (F.col("time") < F.col("etime")))
        .drop("_bucket")
    )


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of [start, end] inside the window [low, high]."""
    return F.greatest(start, low), F.least(end, high)


def window_clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Three-branch clip kept for parity.

    A start inside the window always runs to the window's end, an interval that
    ends inside the window starts at the window's start, all else is the window.
    """
    starts_inside = (low < start) & (high > start)
    ends_inside = (low >= start) & (high > end)
    return (
        F.when(starts_inside, start).otherwise(low),
        F.when(~starts_inside & ends_inside, end).otherwise(high),
    )


def next_pairs(times: DataFrame) -> DataFrame:
    """Successive time points of each batch: (batch_id, time, earlier).

    The window holds the distinct time points of one batch.
    """
    order = Window.partitionBy("batch_id").orderBy("time")
    return times.select(
        "batch_id", "time", F.lag("time").over(order).alias("earlier")
    ).where(F.col("earlier").isNotNull())
