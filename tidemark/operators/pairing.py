"""Examples per time point: same-time groups, shifted labels, dataset names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FRAME_STEP
from tidemark.functions.atoms import ANNOTATION
from tidemark.operators.nesting import nest_examples


def same_time_pairs(
    atoms: DataFrame, by: Sequence[str], order: Sequence[str], max_atoms: int = 100_000
) -> DataFrame:
    """One document per time: (by, time, part, annotation, narrative)."""
    return nest_examples(atoms, [*by, "time"], order, max_atoms)


def shifted_atoms(atoms: DataFrame, by: Sequence[str], step: int = FRAME_STEP) -> DataFrame:
    """Re-keys annotation atoms to the time ``step`` before them, in one pass.

    Rows are (by, time, role, atom, …, present). An annotation atom becomes two
    rows: itself under the earlier time, and a marker (atom null) that its own
    time exists. A time without a ``present`` row has no example.
    """
    own = F.struct(F.lit(True).alias("present"), F.col("time").alias("at"))
    earlier = F.struct(F.lit(False).alias("present"), (F.col("time") - step).alias("at"))
    keys = F.when(F.col("role") == ANNOTATION, F.array(earlier, own)).otherwise(F.array(own))
    marker = (F.col("role") == ANNOTATION) & F.col("_key.present")
    return (
        atoms.withColumn("_key", F.explode(keys))
        .withColumn("atom", F.when(~marker, F.col("atom")))
        .withColumn("time", F.col("_key.at"))
        .withColumn("present", F.col("_key.present"))
        .drop("_key")
    )


def shift_pairs(
    atoms: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    step: int = FRAME_STEP,
    max_atoms: int = 100_000,
) -> DataFrame:
    """Narrative at t with the annotation at t + ``step`` of the same recording.

    A time without a later annotation has an empty list.
    """
    shifted = shifted_atoms(atoms, by, step)
    return nest_examples(shifted, [*by, "time"], order, max_atoms, required="present")


def activity_flags(
    documents: DataFrame, by: Sequence[str], texts: Sequence[str] = ("meeting", "moving")
) -> DataFrame:
    """Per recording, whether any annotation atom contains each of the texts."""

    def seen(t: str) -> Column:
        found = F.exists("annotation", lambda a: a.contains(t))
        return F.coalesce(F.bool_or(found), F.lit(False)).alias(f"has_{t}")

    return documents.groupBy(*by).agg(*map(seen, texts))


def dataset_name(prefix: Column, texts: Sequence[str] = ("meeting", "moving")) -> Column:
    """``prefix`` followed by the activities a recording contains."""
    return F.concat_ws("-", prefix, *[F.when(F.col(f"has_{t}"), F.lit(t)) for t in texts])
