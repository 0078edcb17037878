"""Vocabulary, field layouts and option objects shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass, field

# The sentinel end of the last batch and the frame step of the
# activity recordings.
END_OF_TIME = 2_000_000_000
FRAME_STEP = 40

# Default event vocabulary of the vessel programs. The order of the
# names is the order of the atoms inside an example.
POINT_EVENTS = (
    "gap_end",
    "change_in_heading",
    "entersArea",
    "stop_start",
    "change_in_speed_start",
    "gap_start",
    "change_in_speed_end",
    "stop_end",
    "leavesArea",
    "slow_motion_end",
    "slow_motion_start",
    "stopped",
    "proximity",
    "lowSpeed",
)
TARGET_EVENTS = ("rendezVous",)

# Point events with a layout of their own.
AREA_EVENTS = ("entersArea", "leavesArea")
UNUSED_EVENTS = ("coord", "velocity")
COORD_EVENT = "coord"
PROXIMITY_EVENT = "proximity"

# Interval events by number of vessels, and those whose vessels
# may be swapped.
SINGLE_VESSEL_INTERVALS = (
    "highSpeedNC",
    "lowSpeed",
    "stopped",
    "trawlingMovement",
    "gap",
    "loitering",
    "changingSpeed",
    "tuggingSpeed",
    "trawling",
    "anchoredOrMoored",
    "sarSpeed",
    "sar",
    "trawlSpeed",
    "underWay",
    "movingSpeed",
    "drifting",
    "sarMovement",
)
VESSEL_PAIR_INTERVALS = ("rendezVous", "tugging", "proximity", "pilotBoarding")
AREA_INTERVALS = ("withinArea",)
SYMMETRIC_INTERVALS = ("rendezVous", "pilotBoarding", "tugging")


@dataclass(frozen=True)
class PointLayout:
    """Zero-based field positions of a pipe-delimited point-event line."""

    name: int = 0
    time: int = 1
    vessel: int = 3
    area: int = 2
    lon: int = 4
    lat: int = 5
    pair: tuple[int, int] = (5, 6)


@dataclass(frozen=True)
class BatchOptions:
    """How point and interval events are cut into mini-batches.

    ``size`` distinct time points make a batch. ``closed`` makes interval
    endpoints touching a batch boundary count as overlap. ``stale_times`` keeps
    the time points that the end of a long interval adds before the batch start.
    ``drop_dangling_tail`` leaves out a last line that alone opens a batch.
    ``remove_noise`` drops events that have a coordinate at the same vessel and
    time; where distances from the coast are known, events beyond ``noise_threshold_m`` go by chance instead, the farther
    the likelier. ``spelling`` of point events is ``terms`` (``happensAt(name(arg),time)``) or ``predicates``
    (``HappensAt(Name_arg,time)``). A row holds ``max_atoms`` atoms at most; with None a batch or document is one row.
    """

    size: int = 50
    point_events: tuple[str, ...] = POINT_EVENTS
    target_events: tuple[str, ...] = TARGET_EVENTS
    closed: bool = False
    stale_times: bool = True
    drop_dangling_tail: bool = False
    remove_noise: bool = False
    noise_threshold_m: float = 10_000.0
    end_of_time: int = END_OF_TIME
    bucket_seconds: int = 4096
    max_atoms: int | None = 100_000
    spelling: str = "terms"


@dataclass(frozen=True)
class FileInput:
    """Where the vessel programs read their text input from.

    With ``coastline_path`` noise is removed by the distance of a vessel's position from the coast.
    """

    points_path: str
    intervals_path: str
    coastline_path: str | None = None
    layout: PointLayout = field(default_factory=PointLayout)
    batch: BatchOptions = field(default_factory=BatchOptions)


@dataclass(frozen=True)
class StoredInput:
    """Which stored example datasets to read, in order, and how to merge them."""

    path: str
    datasets: tuple[str, ...]
    format: str = "parquet"
    chunk_size: int = 1
    target: str | None = None
    sort_by: str | None = "time"
    ascending: bool = True
    purpose: str = "training"
    max_atoms: int = 100_000
