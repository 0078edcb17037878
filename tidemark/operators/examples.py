"""Stored examples: target filter and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.atoms import ANNOTATION, NARRATIVE
from tidemark.operators import ordering
from tidemark.operators.nesting import nest_examples


def keep_target(examples: DataFrame, target: str | None) -> DataFrame:
    """Keeps the annotation atoms that contain ``target``; None keeps all."""
    if target is None:
        return examples
    return examples.withColumn("annotation", F.filter("annotation", lambda a: a.contains(target)))


def merge_chunks(
    examples: DataFrame,
    size: int,
    order: Sequence[str] = ("time", "part"),
    ascending: bool = True,
) -> DataFrame:
    """Concatenates each run of ``size`` examples of a dataset, in order.

    The time is that of the first one; runs do not cross datasets. ``order``
    starts with a non-negative integer and is unique within a dataset. However
    many examples share a time, a window holds at most 4,096 of their parts.
    """
    if size <= 1:
        return examples
    slices = ordering.time_slices(order[0])
    if tuple(order[1:]) == ("part",):
        slices += [F.col(order[0]), F.shiftright("part", 12)]
    numbered = ordering.number_rows(examples, order, slices, ["dataset"], "_row")
    if not ascending:
        counts = examples.groupBy("dataset").agg(F.count("*").alias("_all"))
        numbered = numbered.join(counts, "dataset").withColumn("_row", F.col("_all") - F.col("_row") + 1)
    numbered = numbered.withColumn("chunk", F.floor((F.col("_row") - 1) / size))

    def joined(column: str):
        lists = F.sort_array(F.collect_list(F.struct("_row", column)))
        return F.flatten(F.transform(lists, lambda e: e[column])).alias(column)

    return numbered.groupBy("dataset", "chunk").agg(
        F.min_by("time", "_row").alias("time"), joined(ANNOTATION), joined(NARRATIVE)
    )


def example_atoms(examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per atom: (keys, role, place, atom). No shuffle."""
    roles = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(r).alias("atoms")) for r in (ANNOTATION, NARRATIVE)]
    )
    return (
        examples.select(*keys, F.explode(roles).alias("_list"))
        .select(*keys, "_list.role", F.posexplode("_list.atoms").alias("place", "atom"))
    )


def merge_all(
    examples: DataFrame, order: Sequence[str] = ("time", "part"), max_atoms: int = 100_000
) -> DataFrame:
    """All examples of each dataset as one, in parts of ``max_atoms`` atoms.

    (dataset, part, time, annotation, narrative); the time is that of the first
    example. A dataset of any size is cut into ordered parts, never collected
    into one row.
    """
    first = examples.groupBy("dataset").agg(F.min_by("time", F.struct(*order)).alias("time"))
    atoms = example_atoms(examples, ["dataset", *order])
    slices = [*ordering.int_slices(order[0], 12), *map(F.col, order)]
    held = F.sum(F.coalesce(F.array_size(ANNOTATION), F.lit(0)) + F.coalesce(F.array_size(NARRATIVE), F.lit(0)))
    counts = examples.groupBy("dataset").agg(held.alias("n"))
    merged = nest_examples(atoms, ["dataset"], [*order, "place"], max_atoms, slices, counts=counts)
    return merged.join(first, "dataset")


def whole_text(parts: DataFrame, separator: str = "|") -> DataFrame:
    """The parts of each dataset put together as text: (dataset, part, time, annotation, narrative), part 0.

    Every part becomes one text before the grouping, so a dataset's row is made from one text per part and not from a list
    of all its atoms. Lists without atoms leave no separator behind.
    """
    roles = (ANNOTATION, NARRATIVE)
    texts = [F.when(F.size(c) > 0, F.struct("part", F.array_join(c, separator).alias("text"))).alias(c) for c in roles]
    told = [F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda p: p["text"]), separator).alias(c) for c in roles]
    return (
        parts.select("dataset", "time", *texts)
        .groupBy("dataset")
        .agg(F.lit(0).cast("bigint").alias("part"), F.min("time").alias("time"), *told)
    )
