"""Small helpers shared by the operators: staged frames, free column names, batches of rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder, stage_in

#: Fixed size of a filter that goes to the tasks, whatever the number of hashes in it: 2 ** 25 bits, 4 MB.
FILTER_BITS = 25

#: Bytes of rows that a Python worker gets at once; the rows of a batch lie in the memory of the executor and of its worker.
BATCH_BYTES = 4 << 20

ROOT = str(Path(__file__).resolve().parents[2])


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this library when it is run from a checkout instead of being installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, known]))


def small_batches(spark: SparkSession) -> None:
    """Sends rows to Python workers in batches of ``BATCH_BYTES`` at most, or of one row, instead of 64 MB; a lower setting stays.

    The setting is read when a frame runs, so it stays set. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name, None)
    if known is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(known) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def stage(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame stored in the shared folder and read back: no lineage, nothing kept on an executor."""
    reach_workers(frame.sparkSession)
    return stage_in(frame.sparkSession, purpose)(frame)


def store(frame: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the folder, for tables that ``remove`` takes away once what was made of them is stored."""
    spark = frame.sparkSession
    reach_workers(spark)
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more, by the file system that holds them."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that is no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    return next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in taken)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts hold about ``most`` bytes together, so that work arrays stay in the cache.

    A single longer text is a slice of its own. No row is left out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size) + 1
        yield batch.slice(begin)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash of the column ``h``; at most 2 ** FILTER_BITS / 64 words reach the driver."""
    bit = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    words = hashes.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v"))
    table = words.toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[table["w"].to_numpy(dtype=np.int64)] = table["v"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_filter(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64((1 << FILTER_BITS) - 1)
    return (filter_[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(ids: DataFrame, column: Column) -> Column:
    """True for every value that stands in the one column of ``ids``, and for a share of the others; an exact join follows.

    The filter has a fixed size, so that rows with long texts are told apart where they lie instead of being shuffled.
    """
    reach_workers(ids.sparkSession)
    sent = ids.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64(ids.columns[0]).alias("h"))))

    def run(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, h.to_numpy().view(np.uint64)))

    return F.pandas_udf(run, "boolean")(F.xxhash64(column))


def without_rows(docs: DataFrame, lost: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is not in the one column of ``lost``, called ``row`` too; store both before.

    Only rows that the filter does not clear are joined, so the texts of the others are not shuffled.
    """
    doubtful = may_be_in(lost, F.col(row))
    return docs.where(~doubtful).unionByName(docs.where(doubtful).join(lost, row, "left_anti"))


def at_least(n: int, low: int) -> int:
    """Bits so that 2 ** bits groups of ``low`` rows hold ``n`` rows."""
    return max(0, math.ceil(math.log2(max(1, n) / low)))
