"""Writers; every target is replaced unless appending is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("append", "overwrite")


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"specify append or overwrite, not {mode!r}")
    return mode


def write_examples(
    examples: DataFrame, path: str, mode: str = "overwrite", format: str = "parquet"
) -> None:
    """Example documents, one folder per dataset where there is a dataset column."""
    writer = examples.write.mode(_checked(mode)).format(format)
    if "dataset" in examples.columns:
        writer = writer.partitionBy("dataset")
    writer.save(path)


def write_clustered(
    examples: DataFrame, path: str, key: str = "time", ascending: bool = True, partitions: int | None = None
) -> None:
    """Examples range-partitioned and sorted by ``key``.

    Files then cover narrow key ranges, and their statistics let a reader skip
    the rest. Range bounds are sampled, and a key shared by many rows stays in
    one range only if its size allows: the full row order breaks ties.
    """
    order = F.asc(key) if ascending else F.desc(key)
    tie = F.xxhash64(*[c for c in examples.columns if c != key])
    ranges = [order, tie]
    placed = (
        examples.repartitionByRange(partitions, *ranges) if partitions else examples.repartitionByRange(*ranges)
    )
    placed.sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def write_lines(
    lines: DataFrame, path: str, order: Sequence[str], column: str = "line", mode: str = "append"
) -> None:
    """Text lines in ``order``: file by file and line by line.

    Sorting samples its input first, so pass a stored frame if it is costly.
    """
    lines.orderBy(*order).select(column).write.mode(_checked(mode)).text(path)
