"""Point events, positions, intervals and coastline from text files.

Every reader returns lazy columns of one text scan. Lines that do not fit go to
``rejects`` functions instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import PointLayout
from tidemark.operators import ordering


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited lines as (seq, fields), in file order.

    ``seq`` grows along each file and is unique in the scan, without a shuffle.
    """
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("seq"), F.split("value", r"\|").alias("fields")
    )


def _field(i: int) -> Column:
    return F.get("fields", F.lit(i))


def point_events(
    lines: DataFrame,
    names: Sequence[str] | None = config.POINT_EVENTS,
    layout: PointLayout = PointLayout(),
) -> DataFrame:
    """Point events of the listed names: (seq, lle, time, vessel, area).

    A proximity event names its two vessels after its own start, end and value;
    they are joined by a comma into ``vessel``.
    """
    name = _field(layout.name)
    events = lines.select(
        "seq",
        name.alias("lle"),
        _field(layout.time).try_cast("bigint").alias("time"),
        _vessel(layout).alias("vessel"),
        F.when(name.isin(*config.AREA_EVENTS), _field(layout.area)).alias("area"),
    )
    if names is not None:
        events = events.where(F.col("lle").isin(*names))
    return events.where(F.col("time").isNotNull() & F.col("vessel").isNotNull())


def _vessel(layout: PointLayout) -> Column:
    """The vessel of a point event, both of a proximity event; null where one is missing or empty."""
    both = [F.when(F.length(_field(i)) > 0, _field(i)) for i in layout.pair]
    pair = F.when(F.size(F.array_compact(F.array(*both))) == len(both), F.concat_ws(",", *both))
    return F.when(_field(layout.name) == config.PROXIMITY_EVENT, pair).otherwise(_field(layout.vessel))


def point_rejects(
    lines: DataFrame,
    names: Sequence[str] | None = config.POINT_EVENTS,
    layout: PointLayout = PointLayout(),
) -> DataFrame:
    """Lines of the listed names that ``point_events`` leaves out."""
    listed = lines if names is None else lines.where(_field(layout.name).isin(*names))
    return listed.where(_field(layout.time).try_cast("bigint").isNull() | _vessel(layout).isNull())


def classified_points(
    lines: DataFrame,
    names: Sequence[str] | None = config.POINT_EVENTS,
    layout: PointLayout = PointLayout(),
) -> DataFrame:
    """Point events of the listed names and their rejects in one pass: the columns of both, and ``rejected``.

    ``fields`` is kept for rejects only.
    """
    listed = lines if names is None else lines.where(_field(layout.name).isin(*names))
    time, vessel = _field(layout.time).try_cast("bigint"), _vessel(layout)
    rejected = time.isNull() | vessel.isNull()
    area = F.when(_field(layout.name).isin(*config.AREA_EVENTS), _field(layout.area))
    return listed.select(
        "seq",
        _field(layout.name).alias("lle"),
        time.alias("time"),
        vessel.alias("vessel"),
        area.alias("area"),
        F.when(rejected, F.col("fields")).alias("fields"),
        rejected.alias("rejected"),
    )


def classified_intervals(lines: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Interval events and their rejects in one pass: the columns of both, and ``rejected``."""
    parsed = lines.select("seq", *_interval_columns(False), "fields")
    if names is not None:
        parsed = parsed.where(F.col("hle").isin(*names))
    rejected = ~_complete()
    return parsed.withColumns({"fields": F.when(rejected, F.col("fields")), "rejected": rejected})


def observed(classified: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and their numbers of kept and rejected ones as seen by the first action on them."""
    counts = Observation(name)
    bad = F.col("rejected")
    return classified.observe(counts, F.count_if(~bad).alias("kept"), F.count_if(bad).alias("rejected")), counts


def _position_columns(layout: PointLayout) -> list[Column]:
    return [
        _field(layout.time).try_cast("bigint").alias("time"),
        _field(layout.vessel).alias("vessel"),
        _field(layout.lon).try_cast("double").alias("lon"),
        _field(layout.lat).try_cast("double").alias("lat"),
    ]


def positions(lines: DataFrame, layout: PointLayout = PointLayout()) -> DataFrame:
    """Positions out of the point-event lines: (time, vessel, lon, lat)."""
    coords = lines.where(_field(layout.name) == config.COORD_EVENT)
    return coords.select(*_position_columns(layout)).dropna()


def coord_rejects(lines: DataFrame, layout: PointLayout = PointLayout()) -> DataFrame:
    """Coordinate lines that ``positions`` leaves out."""
    coords = lines.where(_field(layout.name) == config.COORD_EVENT)
    columns = _position_columns(layout)
    missing = columns[0].isNull() | columns[1].isNull()
    for c in columns[2:]:
        missing = missing | c.isNull() | F.isnan(c)
    return coords.where(missing)


def interval_events(
    lines: DataFrame, names: Sequence[str] | None = None, strict: bool = False
) -> DataFrame:
    """Interval events of the listed names: (seq, hle, vessels, value, stime, etime).

    An unknown name has no vessels: its line is left to ``interval_rejects``, or
    raises when ``strict``.
    """
    parsed = lines.select("seq", *_interval_columns(strict))
    if names is not None:
        parsed = parsed.where(F.col("hle").isin(*names))
    return parsed.where(_complete())


def interval_rejects(lines: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    parsed = lines.select("seq", "fields", *_interval_columns(False))
    if names is not None:
        parsed = parsed.where(F.col("hle").isin(*names))
    return parsed.where(~_complete()).select("seq", "fields")


def _complete() -> Column:
    return F.col("vessels").isNotNull() & F.col("stime").isNotNull() & F.col("etime").isNotNull()


def _interval_columns(strict: bool) -> list[Column]:
    hle = _field(0)
    unknown = F.lit(None).cast("array<string>")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown interval event: "), hle)).cast("array<string>")
    vessels = (
        F.when(hle.isin(*config.SINGLE_VESSEL_INTERVALS), F.array(_field(1)))
        .when(
            hle.isin(*config.VESSEL_PAIR_INTERVALS, *config.AREA_INTERVALS),
            F.array(_field(1), _field(2)),
        )
        .otherwise(unknown)
    )
    return [
        hle.alias("hle"),
        vessels.alias("vessels"),
        _field(3).alias("value"),
        _field(4).try_cast("bigint").alias("stime"),
        _field(5).try_cast("bigint").alias("etime"),
    ]


def coastline_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (ring, pos, x, y) of geometry text, in the order of the text.

    Records are cut at commas, so a vertex is one record and even a single ring on a single line is read by many tasks:
    each reads a byte range and owns the records that start in it. A vertex behind ``(`` starts a ring. Rings and places in
    them are counted over the byte ranges, not in one task; what lies between two ranges is joined where neighbours are
    (``coast_segments``).
    """
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    records = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.posexplode(F.regexp_extract_all("value", F.lit(rf"\(?\s*{number}\s+{number}"), F.lit(0))).alias("_k", "_pair"),
    )
    xy = F.split(F.regexp_replace("_pair", r"^\(?\s*", ""), r"\s+")
    vertices = records.select(
        "_file",
        "_block",
        "_at",
        "_k",
        F.col("_pair").startswith("(").alias("_starts"),
        F.get(xy, F.lit(0)).try_cast("double").alias("x"),
        F.get(xy, F.lit(1)).try_cast("double").alias("y"),
    )
    order = ["_file", "_block", "_at", "_k"]
    slices = [F.col("_file"), F.col("_block"), F.shiftright("_at", 16)]
    told = ordering.running_sum(vertices, F.col("_starts").cast("bigint"), order, slices, name="ring")
    slices = [*slices[:2], F.shiftright("_at", 16)]
    placed = ordering.running_sum(told, F.lit(1), order, slices, name="_place")
    first = placed.groupBy("ring").agg(F.min("_place").alias("_first"))
    return placed.join(first, "ring").select("ring", (F.col("_place") - F.col("_first")).alias("pos"), "x", "y")
