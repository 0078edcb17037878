"""Removal of events that coincide with a recorded position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import uniform
from tidemark.operators.intervals import contain_join


def located_keys(coords: DataFrame) -> DataFrame:
    """Distinct (vessel, time) of the positions.

    Store it before joining when a vessel and time may hold a large share of the
    events: a join right on top of a distinct is not split by adaptive execution.
    """
    return coords.select("vessel", "time").distinct()


def drop_located(events: DataFrame, located: DataFrame, vessel: Column, time: Column) -> DataFrame:
    """Events whose vessel and time are not among the located keys."""
    at = located.select(F.col("vessel").alias("_vessel"), F.col("time").alias("_time"))
    return events.join(at, (vessel == at["_vessel"]) & (time == at["_time"]), "left_anti")


def drop_located_intervals(
    atoms: DataFrame, located: DataFrame, point_events: tuple[str, ...]
) -> DataFrame:
    """Interval atoms at a time point, less point-like ones with a located vessel.

    The key is null for all other names, so they are never matched.
    """
    first_vessel = F.when(F.col("hle").isin(*point_events), F.get("vessels", F.lit(0)))
    return drop_located(atoms, located, first_vessel, F.col("time"))


def contained_without_located(
    times: DataFrame, intervals: DataFrame, located: DataFrame, point_events: tuple[str, ...]
) -> DataFrame:
    """``drop_located_intervals`` of the times that intervals contain, before the containment makes rows.

    Every listed interval gets the located times of its first vessel in its bucket, so a list is bounded by the width of a
    bucket and what moves is a row per interval and bucket, not one per contained time.
    """
    first_vessel = F.when(F.col("hle").isin(*point_events), F.get("vessels", F.lit(0)))

    def mark(listed: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
        at = located.groupBy(F.col("vessel").alias("_vessel"), bucket(F.col("time")).alias("_bucket"))
        # The bucket is part of the key, so intervals that have no key vessel are spread all the same.
        return listed.withColumn("_vessel", first_vessel).join(
            at.agg(F.collect_set("time").alias("_located")), ["_vessel", "_bucket"], "left"
        ).drop("_vessel")

    found = contain_join(times, intervals, mark=mark)
    gone = F.coalesce(F.array_contains("_located", F.col("time")), F.lit(False))
    return found.where(~gone).drop("_located")


def _draw(vessel: Column, time: Column, event: Column, seq: Column, seed: int) -> Column:
    """A number in [0, 1) made from the event itself, so a repeated task takes the same decision."""
    return uniform(vessel, time, event, seq, seed=seed)


def _odds(threshold_m: float) -> Column:
    return F.lit(1.0) - F.try_divide(F.lit(threshold_m), F.col("dist_m"))


def drop_far_from_coast(
    points: DataFrame, distances: DataFrame, threshold_m: float = 10_000.0, seed: int = 0, event: str = "lle"
) -> DataFrame:
    """Drops a located event with probability ``1 - threshold / distance``.

    ``distances`` is (vessel, time, dist_m), one row per key. The draw is a hash
    of the event, so a repeated task takes the same decision.
    """
    drawn = _draw(F.col("vessel"), F.col("time"), F.col(event), F.col("seq"), seed)
    dropped = F.coalesce(drawn <= _odds(threshold_m), F.lit(False))
    return points.join(distances, ["vessel", "time"], "left").where(~dropped).select(*points.columns)


def distance_odds(distances: DataFrame, threshold_m: float = 10_000.0) -> DataFrame:
    """(vessel, time, odds): the chance that an event there is dropped, where there is any."""
    return distances.select("vessel", "time", _odds(threshold_m).alias("odds")).where(F.col("odds") >= 0)


def certain_odds(located: DataFrame) -> DataFrame:
    """(vessel, time, odds) for located keys whose events are always dropped."""
    return located.select("vessel", "time", F.lit(1.0).alias("odds"))


def noisy_times(odds: DataFrame, times: DataFrame) -> DataFrame:
    """(batch_id, vessel, noisy): the time points of a batch at which a vessel's events may go, with the odds.

    Only time points of batches are kept, so a list is at most as long as that of its batch.
    """
    at = times.select("batch_id", "time")
    listed = F.collect_list(F.struct("time", "odds")).alias("noisy")
    return odds.join(at, "time").groupBy("batch_id", "vessel").agg(listed)


def mark_noisy(pairs: DataFrame, noisy: DataFrame, point_events: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Adds ``noisy`` to the (batch, interval) pairs: the times in them at which their draw lets their atoms go, null if none are known.

    Only point-like events have any, by their first vessel. Drawn is once for a pair and located time, not for every atom.
    """
    first = F.when(F.col("hle").isin(*point_events), F.get("vessels", F.lit(0)))
    keyed = noisy.withColumnRenamed("vessel", "_vessel")

    def goes(n: Column) -> Column:
        drawn = _draw(F.get("vessels", F.lit(0)), n["time"], F.col("hle"), F.col("seq"), seed)
        return (F.col("stime") < n["time"]) & (n["time"] < F.col("etime")) & (drawn <= n["odds"])

    gone = F.transform(F.filter("noisy", goes), lambda n: n["time"])
    return pairs.withColumn("_vessel", first).join(keyed, ["batch_id", "_vessel"], "left").drop("_vessel").withColumn("noisy", gone)


def drop_noisy(atoms: DataFrame) -> DataFrame:
    """Atoms of marked pairs at their ``time``, less those that go."""
    return atoms.where(~F.coalesce(F.array_contains("noisy", F.col("time")), F.lit(False)))
