"""Activity recordings: statement files in one folder per video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import folder_number, without_whitespace
from tidemark.operators import ordering

# Parts of the file names that hold statements.
STATEMENT_FILES = ("AppearenceIndv", "MovementIndv", "SituationGrp")
MOVEMENT_FILES = ("MovementIndv",)


def read_lines(spark: SparkSession, path: str, tags: Sequence[str] = STATEMENT_FILES) -> DataFrame:
    """Lines of the tagged files: (path, file, folder, block, line, value).

    Other files are skipped when listing. (block, line) is the order in a file.
    """
    parts = F.split("_metadata.file_path", "/")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{{{','.join(tags)}}}*")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.element_at(parts, -1).alias("file"),
            F.element_at(parts, -2).alias("folder"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )


def statements(lines: DataFrame) -> DataFrame:
    """Statements (path, file, folder, video, position, statement).

    Comment lines are dropped and the text of each file is cut at full stops,
    white space removed; a statement may span lines. A statement's number is the
    count of full stops before it, a running sum over file blocks, so no file is
    read into one row.
    """
    code = lines.where(~F.col("value").startswith("%"))
    stops = F.size(F.split("value", r"\.", -1)) - 1
    counted = ordering.running_sum(
        code.withColumn("_stops", stops),
        F.col("_stops"),
        ["line"],
        [F.col("block")],
        ["path", "file", "folder"],
        "_through",
    )
    pieces = counted.select(
        "path",
        "file",
        "folder",
        "block",
        "line",
        (F.col("_through") - F.col("_stops")).alias("_first"),
        F.posexplode(F.split("value", r"\.", -1)).alias("_place", "_piece"),
    ).withColumn("position", F.col("_first") + F.col("_place"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "line", "_piece")))
    text = F.array_join(F.transform(ordered, lambda p: p["_piece"]), "")
    return (
        pieces.groupBy("path", "file", "folder", "position")
        .agg(without_whitespace(text).alias("statement"))
        .where(F.col("statement") != "")
        .withColumn("video", folder_number(F.col("folder")).cast("bigint"))
    )


def numbered_videos(folders: DataFrame) -> DataFrame:
    """(folder, video, number): 1-based place of each folder by its number."""
    distinct = folders.select("folder", folder_number(F.col("folder")).cast("bigint").alias("video")).distinct()
    return ordering.number_rows(
        distinct, ["video", "folder"], ordering.int_slices("video", 12), name="number"
    )
