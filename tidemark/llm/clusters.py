"""Centroid clustering of whole-number vectors: exact inner products are kept per vector and changed by what the centroids moved."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import reach_workers, remove, store

#: Components below this keep every distance of up to 512 components within 64 bits.
_MOST = 1 << 27


@dataclass(frozen=True)
class Settings:
    """``k`` centroids over ``rounds`` rounds; components are ``floor(factor * x)``; ``block`` vectors are kept in a row."""

    k: int = 8
    rounds: int = 10
    size: int = 64
    factor: int = 1024
    seed: int = 3
    block: int = 4096


def usable(column: str, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, all of them finite numbers."""
    c = F.col(f"`{column}`")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == size) & finite, F.lit(False))


def whole(batch: pa.Array, how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places, components) of the usable vectors of a list array; components are 64-bit integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch), how.size), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = batch.filter(fits).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, how.size)
    finite = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[finite] * how.factor)
    if scaled.size and np.abs(scaled).max() >= _MOST:
        raise ValueError(f"a component times {how.factor} is {np.abs(scaled).max():g}: distances would not fit 64 bits")
    return places[finite], scaled.astype(np.int64)


def narrow(rows: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes a component."""
    most = int(np.abs(rows).max(initial=0))
    return rows.astype("<i2" if most < 1 << 15 else "<i4")


def widened(data: bytes, n: int, size: int) -> np.ndarray:
    kind = {2: "<i2", 4: "<i4"}[len(data) // (n * size)]
    return np.frombuffer(data, kind).reshape(n, size).astype(np.int64)


def moved(products: np.ndarray, rows: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The inner products after the centroids changed: only components that changed are read."""
    out = products.copy()
    for j, step in enumerate(change):
        (at,) = np.nonzero(step)
        if at.size:
            out[:, j] += rows[:, at] @ step[at]
    return out


def nearest(products: np.ndarray, rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number."""
    away = (rows * rows).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)
    cluster = away.argmin(axis=1)
    return cluster, away[np.arange(len(rows)), cluster]


def sums_of(cluster: np.ndarray, away: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Per cluster the component sums, the number of rows and the distance, one after the other."""
    out = np.zeros((k, rows.shape[1] + 2), np.int64)
    for j in range(k):
        mine = cluster == j
        out[j, :-2], out[j, -2] = rows[mine].sum(axis=0), mine.sum()
    high, low = np.divmod(away, 1 << 32)
    totals = [(int(high[cluster == j].sum()) << 32) + int(low[cluster == j].sum()) for j in range(k)]
    if max(totals, default=0) >= 1 << 63:
        raise ValueError("the distances of a block do not fit 64 bits")
    out[:, -1] = totals
    return out.ravel()


def first_centroids(vectors: DataFrame, id_column: str, vector: str, how: Settings) -> np.ndarray:
    """The ``k`` usable vectors with the least SHA-256 of ``seed:id``, equal ids by their components; a bounded read."""
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    picked = (
        vectors.where(usable(vector, how.size))
        .select(F.sha2(F.concat(F.lit(f"{how.seed}:"), name), 256).alias("h"), F.col(f"`{vector}`").alias("v"))
        .orderBy("h", "v")
        .limit(how.k)
        .collect()
    )
    values = pa.array([r["v"] for r in picked], pa.list_(pa.float64()))
    return whole(values, how)[1]


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", how: Settings = Settings()) -> DataFrame:
    """One row per usable vector: its id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors that are null, of another length or hold a null or non-finite component take no part. Rows with equal ids are
    vectors of their own; a null id stays null and counts as the text ``null`` where the first centroids are drawn. Equal
    vectors share a cluster, ties go to the smaller number. With fewer vectors than ``k`` there are fewer centroids; a
    centroid without vectors stays where it is. An empty table gives an empty result. Other columns are not read. Numbers
    whose distances or sums do not fit 64 bits raise an error.

    Vectors lie in blocks with their inner products with all centroids, exact integers. A round adds to these what the
    changed components of each centroid contribute, takes the least distance anew, and stores the blocks with one sum
    per cluster and component; the round before is then removed from the shared folder. Only the k * (size + 2) totals reach
    the driver. Once no centroid moves, further rounds would change nothing and are left out.
    """
    reach_workers(vectors.sparkSession)
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    source = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    centroids = first_centroids(vectors, id_column, vector, how)
    k = len(centroids)
    result = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not k:
        return _named(spark.createDataFrame([], result), id_column)
    schema = f"ids array<{kind}>, n int, x binary, products binary, cluster binary, away binary, sums array<bigint>"

    def rounded(centroids: np.ndarray, change: np.ndarray):
        def row(ids: pa.Array, rows: np.ndarray, x: bytes, products: np.ndarray) -> pa.RecordBatch:
            products = moved(products, rows, change)
            cluster, away = nearest(products, rows, centroids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids),
                    pa.array([len(rows)], pa.int32()),
                    pa.array([x], pa.binary()),
                    pa.array([products.astype("<i8").tobytes()], pa.binary()),
                    pa.array([cluster.astype("<i2").tobytes()], pa.binary()),
                    pa.array([away.astype("<i8").tobytes()], pa.binary()),
                    pa.array([sums_of(cluster, away, rows, k).tolist()], pa.list_(pa.int64())),
                ],
                ["ids", "n", "x", "products", "cluster", "away", "sums"],
            )

        return row

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = rounded(centroids, centroids)
        for batch in batches:
            places, rows = whole(batch.column(1), how)
            for at in range(0, len(rows), how.block):
                part = rows[at : at + how.block]
                ids = batch.column(0).take(pa.array(places[at : at + how.block]))
                yield row(ids, part, narrow(part).tobytes(), np.zeros((len(part), k), np.int64))

    state, path = store(source.mapInArrow(build, schema), "clusters")
    totals = _totals(state, k, how.size)
    for _ in range(how.rounds):
        after = np.array(
            [[int(s) // n for s in t[:-2]] if (n := t[-2]) else c.tolist() for t, c in zip(totals, centroids)], np.int64
        )
        change = after - centroids
        if not change.any():
            break
        centroids = after

        def follow(batches: Iterator[pa.RecordBatch], centroids=centroids, change=change) -> Iterator[pa.RecordBatch]:
            row = rounded(centroids, change)
            for batch in batches:
                for i in range(batch.num_rows):
                    n, x = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    before = np.frombuffer(batch.column(3)[i].as_py(), "<i8").reshape(n, k)
                    yield row(batch.column(0)[i].values, widened(x, n, how.size), x, before)

        state, newer = store(state.select("ids", "n", "x", "products").mapInArrow(follow, schema), "clusters")
        remove(spark, path)
        path = newer
        totals = _totals(state, k, how.size)

    inertias = [t[-1] for t in totals]
    if sum(inertias) >= 1 << 63:
        raise ValueError("the summed distances do not fit 64 bits")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cluster, sha = pa.array(inertias, pa.int64()), pa.array(names, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(1)[i].as_py()
                cluster = pa.array(np.frombuffer(batch.column(2)[i].as_py(), "<i2").astype(np.int32))
                away = pa.array(np.frombuffer(batch.column(3)[i].as_py(), "<i8"))
                total = pa.array(np.full(n, sum(inertias), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, cluster, away, by_cluster.take(cluster), total, sha.take(cluster)],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return _named(state.select("ids", "n", "cluster", "away").mapInArrow(listed, result), id_column)


def _named(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.toDF(id_column, *rows.columns[1:])


def _totals(state: DataFrame, k: int, size: int) -> list[list[int]]:
    """Per cluster the exact component sums, the number of vectors and their distance."""
    cells = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [0] * (k * (size + 2))
    for r in cells.collect():
        out[r["at"]] = int(r["s"])
    return [out[j * (size + 2) : (j + 1) * (size + 2)] for j in range(k)]
