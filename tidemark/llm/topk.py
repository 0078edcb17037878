"""Exact top-k search by inner product: blocks of rows in the order of their bounds, until no block can add a hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import reach_workers, stage


@dataclass(frozen=True)
class Settings:
    """``block`` rows are bounded together; a task searches ``shard`` rows for ``chunk`` queries."""

    k: int = 20
    block: int = 512
    shard: int = 8192
    chunk: int = 2048


def whole_components(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component as bigints.

    Vectors that are null or hold a null or non-finite component go, as do null ids; components beyond 64 bits are cut
    to the ends of their range. Rows with one id are all kept.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    edge = float(1 << 62)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), factor * x.cast("double")))).cast("bigint"))
    return usable.select("vec_id", whole.alias("v"))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows of a common width, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits are cut to the ends of the range."""
    if queries.size == 0 or rows.size == 0:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if most < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Block:
    """A range of rows by id with the greatest positive and negative part of each component: the term maxima."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.high, self.low = rows.max(axis=0).astype(np.float64), rows.min(axis=0).astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of the block scores more than this: the sum over components of the query's part times the maximum."""
        q = queries.astype(np.float64)
        bound = np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low
        # Room for rounding where numbers are beyond exact doubles.
        return bound + np.abs(bound) * 1e-9


def search(blocks: list[Block], ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row id, score) of each query's k best rows of the blocks but its own, ties to smaller ids.

    Each query takes the blocks by falling bound and stops once a block's bound is below its kth score; queries that take
    the same block next are scored together.
    """
    n = len(ids)
    bounds = np.stack([b.bounds(queries) for b in blocks], axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [np.zeros((0,), np.int64)] * 3
    kth = np.full(n, np.iinfo(np.int64).min)
    for turn in range(len(blocks)):
        turn_block = order[:, turn]
        open_ = bounds[np.arange(n), turn_block] >= kth
        if not open_.any():
            break
        found = [best]
        for b in np.unique(turn_block[open_]):
            block = blocks[b]
            group = np.flatnonzero(open_ & (turn_block == b))
            for low in range(0, group.size, 512):
                who = group[low : low + 512]
                scores = products(queries[who], block.rows)
                own = ids[who][:, None] == block.ids[None, :]
                least = kth[who]
                if scores.shape[1] > k:
                    # However many rows have the query's own id, they are not among its k best.
                    others = np.where(own, np.iinfo(np.int64).min, scores)
                    least = np.maximum(least, np.partition(others, -k, axis=1)[:, -k])
                q, c = np.nonzero((scores >= least[:, None]) & ~own)
                found.append(_best(who[q], block.ids[c], scores[q, c], k))
        best = _best(*(np.concatenate(x) for x in zip(*found)), k)
        place, number = np.unique(best[0], return_counts=True)
        last = np.cumsum(number) - 1
        full = number >= k
        kth[place[full]] = best[2][last[full]]
    return tuple(best)


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of each query, in order of query, falling score and id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(q.size) - first < k
    return [q[keep], ids[keep], scores[keep]]


def top_k(vectors: DataFrame, is_query: Column, how: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``how.k`` highest inner products of each query with all other rows.

    ``vectors`` has (vec_id, v), as ``whole_components`` makes them; other columns are not read. Shorter vectors count as filled
    with zeros. Rows with one id are rows of their own: each is found, none is a partner of another, and where they ask
    their partners are ranked together. Ties go to smaller ids; a query with fewer partners gets all. Rows are cut by id into shards, queries
    into chunks; every pair of a shard and a chunk is one task's work and gives k rows a query at most, which are merged
    by a ranked window. An empty table or no query gives an empty result.
    """
    spark = vectors.sparkSession
    reach_workers(spark)
    numbered = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("at")
    )
    rows = stage(numbered, "vectors")
    counts = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    width = max(1, counts[2] or 0)
    shards, chunks = -(-counts[0] // how.shard) or 1, -(-counts[1] // how.chunk) or 1
    ranged = rows.repartitionByRange(shards, "vec_id", "at").select("vec_id", "v", F.spark_partition_id().alias("shard"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    asked = rows.where("asks").select("vec_id", "v", chunk.alias("chunk"))
    # Each shard meets each chunk once; what is copied is (rows x chunks) + (queries x shards) vectors.
    data = ranged.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    questions = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(data: pa.Table, questions: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if data.num_rows and questions.num_rows:
            ids = data.column("vec_id").to_numpy()
            matrix = _matrix(data.column("v").to_pylist(), width)
            order = np.argsort(ids)
            ids, matrix = ids[order], matrix[order]
            blocks = [Block(ids[i : i + how.block], matrix[i : i + how.block]) for i in range(0, len(ids), how.block)]
            asking = questions.column("vec_id").to_numpy()
            place, row, score = search(blocks, asking, _matrix(questions.column("v").to_pylist(), width), how.k)
            out = [asking[place], row, score]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    found = data.groupBy("shard", "chunk").cogroup(questions.groupBy("shard", "chunk")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
