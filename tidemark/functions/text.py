"""Small text, time and random helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def folder_number(folder: Column) -> Column:
    """Integer before the first dash of a folder name."""
    return F.split(folder, "-")[0].try_cast("int")


def subject_name(file_name: Column) -> Column:
    """Lower-cased text before the first dash of a file name."""
    return F.lower(F.split(file_name, "-")[0])


def epoch_seconds(c: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds of a date-time string read in ``zone``, whatever the session zone.

    Null when the text does not parse.
    """
    zoned = F.concat_ws(" ", c, F.lit(zone))
    return F.unix_timestamp(F.try_to_timestamp(zoned, F.lit(f"{pattern} VV")))


def uniform(*columns: Column, seed: int = 0) -> Column:
    """Reproducible pseudo-random number in [0, 1) drawn per key, not per run: 32 bits of the MD5 of the joined key."""
    key = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
