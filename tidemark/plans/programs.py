"""The end-to-end programs: raw files in, stored examples or text out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FRAME_STEP, FileInput
from tidemark.functions.text import epoch_seconds
from tidemark.operators import batching, coast, ordering, pairing, series as S, statements as ST, wide as W
from tidemark.plans import vessel_batches as V
from tidemark.session import stage_in
from tidemark.sinks import writers
from tidemark.sources import recordings as R, tables, vessels

# Order of the atoms of a recording inside one document.
_RECORDING_ORDER = ("file", "position", "place", "pair")


@dataclass(frozen=True)
class VesselInput:
    """What was read from event and interval files, each in one pass: events, rejects, and how many of both."""

    points: DataFrame
    intervals: DataFrame
    point_rejects: DataFrame
    interval_rejects: DataFrame
    counts: dict[str, dict[str, int]]


def read_vessels(spark: SparkSession, files: FileInput) -> VesselInput:
    """Reads the event and interval files once each. Kept rows and rejects are stored side by side and counted meanwhile."""
    options = files.batch
    stage = stage_in(spark)
    names = (*options.point_events, *options.target_events)
    # Arrival numbers of a scan belong to that scan: store the events once.
    points, seen_points = vessels.observed(
        vessels.classified_points(vessels.read_fields(spark, files.points_path), options.point_events, files.layout), "points"
    )
    spans, seen_spans = vessels.observed(
        vessels.classified_intervals(vessels.read_fields(spark, files.intervals_path), names), "intervals"
    )
    points, spans = stage(points), stage(spans)
    return VesselInput(
        points.where("not rejected").drop("rejected", "fields"),
        spans.where("not rejected").drop("rejected", "fields"),
        points.where("rejected").select("seq", "fields"),
        spans.where("rejected").select("seq", "fields"),
        {"points": dict(seen_points.get), "intervals": dict(seen_spans.get)},
    )


def vessel_batches(spark: SparkSession, files: FileInput, read: VesselInput | None = None) -> V.Batches:
    options = files.batch
    read = read or read_vessels(spark, files)
    stage = stage_in(spark)
    coords = distances = None
    lines = vessels.read_fields(spark, files.points_path)
    if files.coastline_path:
        positions = stage(vessels.positions(lines, files.layout))
        vertices = stage(vessels.coastline_vertices(spark, files.coastline_path))
        distances = coast.coast_distance(positions, coast.coast_segments(vertices))
    elif options.remove_noise:
        coords = vessels.positions(lines, files.layout)
    return V.build_batches(read.points, read.intervals, options, coords, stage, distances=distances)


def vessel_examples(spark: SparkSession, files: FileInput) -> DataFrame:
    """Mini-batch examples from event and interval files."""
    return V.batch_examples(vessel_batches(spark, files), files.batch, stage_in(spark))


def write_vessel_examples(spark: SparkSession, files: FileInput, out: str, rejects: str) -> dict[str, dict[str, int]]:
    """Stores the examples, and beside them the lines that do not fit and the events before the first batch.

    Returns the numbers of kept and rejected lines.
    """
    read = read_vessels(spark, files)
    V.batch_examples(vessel_batches(spark, files, read), files.batch, stage_in(spark)).write.mode("overwrite").parquet(out)
    for name, frame in (
        ("points", read.point_rejects),
        ("intervals", read.interval_rejects),
        ("early", batching.early_points(read.points)),
    ):
        frame.write.mode("overwrite").parquet(f"{rejects}/{name}")
    return read.counts


tables.register_input("vessel_files", vessel_examples)


def write_vessel_documents(
    spark: SparkSession, files: FileInput, out: str, merge_by_time: bool = False, dataset: str = "vessels"
) -> None:
    """One stored document per batch and time point, clustered by time, under a dataset's name."""
    documents = V.batch_documents(
        vessel_batches(spark, files), files.batch, merge_by_time, stage_in(spark)
    )
    writers.write_clustered(documents.withColumn("dataset", F.lit(dataset)), out)


def read_recording_atoms(spark: SparkSession, path: str, tags=R.STATEMENT_FILES) -> DataFrame:
    """Atoms of all recording folders: (folder, video, file, position, …, time)."""
    statements = R.statements(R.read_lines(spark, path, tags))
    return ST.recording_atoms(ST.parse_statements(statements))


def write_recordings(spark: SparkSession, path: str, out: str, dataset: str = "recordings") -> None:
    """All videos one after the other on a single time axis, one document per time."""
    stage = stage_in(spark)
    moved = ST.shift_videos(stage(read_recording_atoms(spark, path)), stage=stage)
    atoms = moved.withColumn("atom", ST.render_recording())
    documents = pairing.same_time_pairs(stage(atoms), [], _RECORDING_ORDER)
    writers.write_clustered(documents.withColumn("dataset", F.lit(dataset)), out)


def write_recordings_per_video(
    spark: SparkSession,
    path: str,
    out: str,
    prefix: str = "video",
    shifted: bool = True,
    step: int = FRAME_STEP,
) -> None:
    """One dataset per video, named after its number and the activities in it.

    With ``shifted`` the narrative at a time is paired with the annotation one
    step later, else with that of the same time.
    """
    stage = stage_in(spark)
    numbers = stage(R.numbered_videos(R.read_lines(spark, path)))
    atoms = stage(
        read_recording_atoms(spark, path)
        .withColumn("atom", ST.render_recording())
        .join(numbers.select("folder", "number"), "folder")
    )
    if shifted:
        documents = pairing.shift_pairs(atoms, ["number"], _RECORDING_ORDER, step)
    else:
        documents = pairing.same_time_pairs(atoms, ["number"], _RECORDING_ORDER)
    documents = stage(documents)
    name = F.concat(F.lit(f"{prefix}-"), F.col("number").cast("string"))
    names = stage(
        pairing.activity_flags(documents, ["number"]).select(
            "number", pairing.dataset_name(name).alias("dataset")
        )
    )
    writers.write_examples(documents.join(names, "number").drop("number"), out)


def recording_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Number of interpretations per video and in total, from the movement files."""
    statements = R.statements(R.read_lines(spark, path, R.MOVEMENT_FILES))
    parsed = ST.parse_statements(statements)
    return ST.count_interpretations(
        parsed.select("video", "time", F.explode("persons").alias("id"))
    )


def write_matrix_text(spark: SparkSession, path: str, out: str, mode: str = "append") -> None:
    """A code matrix as lines of atoms per row time; unknown codes fail the write."""
    columns = list(W.MATRIX_COLUMNS)
    labelled = W.label_lookup(tables.read_matrix(spark, path), W.code_dictionary(spark), columns)
    checked = [
        F.when(F.col(c).isNull(), F.raise_error(F.lit(f"unknown code in {c}"))).otherwise(F.col(c)).alias(c)
        for c in columns
    ]
    lines = W.text_lines(W.matrix_atoms(labelled.select("subject", "time", *checked)))
    writers.write_lines(stage_in(spark)(lines.select("subject", "time", "line")), out, ["subject", "time"], mode=mode)


def write_sensor_documents(spark: SparkSession, path: str, out: str, zone: str = "UTC", dataset: str = "sensors") -> None:
    """A wide activity CSV as documents; the last two columns are activity and time."""
    rows = tables.read_wide(spark, path)
    *sensors, activity, timestamp = rows.columns
    timed = rows.withColumn("_time", epoch_seconds(F.col(timestamp), zone))
    documents = W.sensor_documents(timed, sensors, activity, "_time")
    writers.write_clustered(documents.withColumn("dataset", F.lit(dataset)), out)


def write_series_blocks(
    spark: SparkSession,
    folders: Mapping[str, str],
    out: str,
    inferred: DataFrame | None = None,
    mode: str = "append",
) -> None:
    """Model blocks of all series files, numbered over the labels in order.

    ``inferred`` may add atoms as (label, file, time, place, atom).
    """
    keys = ["label", "file"]
    series = tables.read_series(spark, folders)
    slices = [F.col("label_place"), *ordering.spread_slices(series, "file", 2, 4, 6)]
    models = S.number_models(series.select("label_place", *keys), ["label_place", "file"], slices)
    models = models.join(series.select("label_place", "label").distinct(), "label_place")
    atoms = S.with_inferred(S.observations(series, keys), inferred)
    lines = S.model_block_lines(atoms, models, keys)
    writers.write_lines(stage_in(spark)(lines), out, ["model", "section", "time", "place"], mode=mode)
