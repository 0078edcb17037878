"""Wide CSV files, code matrices, series folders and stored examples."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StoredInput
from tidemark.functions.text import subject_name
from tidemark.operators import examples as E
from tidemark.operators import ordering
from tidemark.operators.wide import MATRIX_COLUMNS


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV with a header; all columns stay text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def file_row_numbers(lines: DataFrame, name: str = "time", folder: bool = False) -> DataFrame:
    """Adds the zero-based row number within each file.

    ``lines`` has path, block and line; numbers run over file blocks, so a large
    file is numbered by as many tasks as it has blocks. With ``folder`` the files of a folder are one recording, in the
    order of their names, and numbers run on from file to file.
    """
    if not folder:
        numbered = ordering.number_rows(lines, ["line"], [F.col("block")], ["path"], "_row")
    else:
        there = lines.withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
        numbered = ordering.number_rows(there, ["line"], [F.col("path"), F.col("block")], ["_folder"], "_row").drop("_folder")
    return numbered.withColumn(name, F.col("_row") - 1).drop("_row", "path", "block", "line")


def read_matrix(
    spark: SparkSession,
    path: str,
    subject: Column | None = None,
    columns: Mapping[str, int] = MATRIX_COLUMNS,
    in_files: bool = False,
) -> DataFrame:
    """Space-separated matrix rows: (subject, time, one column per label code).

    Columns are given by one-based place. The time is the row number in the
    file, the subject by default the file name up to the first dash. With ``in_files`` a recording is a folder whose files
    follow each other by name, and the time is the row number in it.
    """
    subject = subject_name(F.col("_metadata.file_name")) if subject is None else subject
    codes = [F.get("_codes", F.lit(place - 1)).alias(name) for name, place in columns.items()]
    lines = (
        spark.read.text(path)
        .select(
            subject.alias("subject"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.split("value", " ").alias("_codes"),
        )
        .select("subject", "path", "block", "line", *codes)
    )
    return file_row_numbers(lines, folder=in_files)


def read_series(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """Series from one folder of CSV files per label: (label, label_place, file, …)."""
    out = None
    for place, (label, path) in enumerate(folders.items()):
        part = spark.read.csv(path, header=True, inferSchema=False).select(
            F.lit(label).alias("label"),
            F.lit(place).alias("label_place"),
            F.col("_metadata.file_name").alias("file"),
            F.col("time").try_cast("bigint").alias("time"),
            "alive",
            "necrotic",
            "apoptotic",
        )
        out = part if out is None else out.unionByName(part)
    return out


def read_examples(spark: SparkSession, options: StoredInput) -> DataFrame:
    """Stored examples of the listed datasets, in list order and sorted.

    The dataset is a partition column, so other datasets are not read.
    """
    stored = spark.read.format(options.format).load(options.path)
    chosen = stored.where(F.col("dataset").isin(*options.datasets))
    place = F.array_position(F.array(*map(F.lit, options.datasets)), F.col("dataset"))
    chosen = chosen.withColumn("dataset_place", place)
    if options.sort_by is None:
        return chosen
    key = F.asc(options.sort_by) if options.ascending else F.desc(options.sort_by)
    return chosen.orderBy("dataset_place", key)


def training_examples(spark: SparkSession, options: StoredInput) -> DataFrame:
    """Stored examples with the target kept, merged as the purpose asks.

    Training merges chunks of ``chunk_size``, anything else merges each dataset, both in the order of ``sort_by`` (a
    non-negative integer column), then time and part; without it by time and part.
    """
    kept = E.keep_target(read_examples(spark, replace(options, sort_by=None)), options.target)
    order = tuple(dict.fromkeys([options.sort_by or "time", "time", "part"]))
    if options.purpose == "training":
        return E.merge_chunks(kept, options.chunk_size, order, ascending=options.ascending)
    return E.merge_all(kept, order, max_atoms=options.max_atoms)


# Pluggable inputs: a function from session and options to examples, one entry
# per name.
InputFunction = Callable[[SparkSession, object], DataFrame]
_INPUTS: dict[str, InputFunction] = {"stored": training_examples}


def register_input(name: str, function: InputFunction) -> None:
    _INPUTS[name] = function


def read_input(name: str, spark: SparkSession, options: object) -> DataFrame:
    return _INPUTS[name](spark, options)
