"""Session settings the operators are designed around."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution coalesces small shuffles, switches to broadcast joins when
# the measured side is small, and splits skewed sort-merge join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Interval joins put out far more rows than they read, so partitions are not
    # merged up to the default size by what they read.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path below the checkpoint directory the cluster names.

    A directory on this machine is chosen only when none is configured and the
    master is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


Stage = Callable[[DataFrame], DataFrame]


def keep(frame: DataFrame) -> DataFrame:
    """The stage that stores nothing."""
    return frame


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run here as soon as it has ended, not when the driver collects its garbage."""
    known = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if known is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, known)


def stage_in(spark: SparkSession, purpose: str = "stage") -> Stage:
    """A function that stores a frame in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. Nothing reads the shuffle files behind a stored
    frame again, so they go at once.
    """
    folder = shared_folder(spark, purpose)
    names = itertools.count()

    def stage(frame: DataFrame) -> DataFrame:
        path = f"{folder}/{next(names)}"
        with shuffles_dropped(spark):
            frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    stage.folder = folder
    return stage


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes stored frames that nothing reads any more, by the file system that holds them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
