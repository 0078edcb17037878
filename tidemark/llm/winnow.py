"""Benchmark passages in documents, found by winnowed fingerprints and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import bit_filter, free_name, in_filter, pieces, reach_workers, stage, without_rows
from tidemark.llm.words import LETTERS, Words, encoded, grams, mix

_SECOND = 0x51


def _winnow(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of each run of ``w`` hashes within a text, the last of equals; each place once.

    ``first`` and ``counts`` give each text's hashes. Texts of fewer hashes have no run.
    """
    n = hashes.size - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # The least of each run with the last of equals: compared as (hash, -place within the run).
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, w):
        lower = hashes[j : j + n] <= best
        best[lower] = hashes[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    runs = np.maximum(0, counts - w + 1)
    starts = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    return np.unique(at[starts])


class Prints:
    """Winnowed fingerprints and window hashes of a batch of texts."""

    def __init__(self, texts: list[str | None], window: int, k: int) -> None:
        self.words = Words(encoded(texts), LETTERS)
        self.one = self.words.hashes()
        self.two = mix(self.one ^ np.uint64(_SECOND)) if self.one.size else self.one
        self.window, self.k = window, k
        counts = self.words.counts
        self.grams = grams(self.one, k)
        n = np.maximum(0, counts - k + 1)
        self.kept = _winnow(self.grams, self.words.first, n, window - k + 1)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in all words where a run of ``length`` words starts within a text, and the texts."""
        n = np.maximum(0, self.words.counts - length + 1)
        owner = np.repeat(np.arange(n.size), n)
        return np.repeat(self.words.first - (np.cumsum(n) - n), n) + np.arange(n.sum()), owner

    def hashes(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the runs of ``length`` words at the places."""
        a, b = np.zeros(places.size, np.uint64), np.zeros(places.size, np.uint64)
        for j in range(length):
            a = a * np.uint64(0xC2B2AE3D27D4EB4F) + self.one[places + j]
            b = b * np.uint64(0x165667B19E3779F9) + self.two[places + j]
        return mix(a), mix(b + np.uint64(length))


def _item_rows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, length, a, b, prints): every distinct window of each item with the winnowed fingerprints in it.

    Items of fewer words are one window of their own length and have no fingerprint but their own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            p = Prints(batch.column(1).to_pylist(), window, k)
            ids = batch.column(0)
            places, owner = p.runs(window)
            a, b = p.hashes(places, window)
            found = [pa.array(p.grams[p.kept[slice(*r)]].view(np.int64)) for r in _within(p.kept, places, window - k)]
            yield _rows(ids, owner, np.full(owner.size, window), a, b, found)
            for length in np.unique(p.words.counts[(p.words.counts > 0) & (p.words.counts < window)]):
                texts = np.flatnonzero(p.words.counts == length)
                a, b = p.hashes(p.words.first[texts], int(length))
                yield _rows(ids, texts, np.full(texts.size, length), a, b, [pa.array(x[None].view(np.int64)) for x in a])

    def _rows(ids, owner, length, a, b, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(owner)),
                pa.array(length, pa.int32()),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.array([x.to_pylist() for x in found], pa.list_(pa.int64())),
            ],
            ["item_id", "length", "a", "b", "prints"],
        )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, length int, a bigint, b bigint, prints array<bigint>")


def _within(kept: np.ndarray, places: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    """For each place, the range of ``kept`` that lies in [place, place + span]."""
    low, high = np.searchsorted(kept, places), np.searchsorted(kept, places + span, side="right")
    return zip(low.tolist(), high.tolist())


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Where windows of the items stand in the documents: (rows, hits).

    ``docs`` and ``items`` have columns (doc_id, text) and (item_id, text). ``rows`` has one row per document row: a
    row number ``row``, doc_id and n_words. ``hits`` has (row, start, length, item_id) for each place and item.

    A shared span of ``window`` words keeps the same least hash of k-grams in both texts, so joining the kept hashes
    finds every one; each hit is extended to the windows around it, which are compared by 128 bits of hash. Items of
    fewer words than a window are looked up whole at every place of documents, by their own lengths (less than
    ``window`` of them). Documents are filtered in the task by two filters of fixed size, so the join gets little
    besides real hits; no item or document is left out at any size.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    spark = docs.sparkSession
    reach_workers(spark)
    windows = stage(_item_rows(items.where("text is not null"), window, k), "windows")
    full = windows.where(F.col("length") == window)
    short = windows.where(F.col("length") < window)
    prints = bit_filter(full.select(F.explode("prints").alias("h")))
    ends = bit_filter(windows.select(F.col("a").alias("h")))
    lengths = sorted(r[0] for r in short.select("length").distinct().collect())
    sent: Broadcast = spark.sparkContext.broadcast((prints, ends, lengths))
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, ends, lengths = sent.value
        for batch in pieces(batches, 1):
            p = Prints(batch.column(1).to_pylist(), window, k)
            hit = p.kept[in_filter(prints, p.grams[p.kept])]
            near = np.unique((hit[:, None] - np.arange(window - k + 1)[None, :]).ravel())
            # Windows are those that lie within one text.
            owner = np.searchsorted(p.words.first, near, side="right") - 1
            ok = near >= 0
            ok &= near + window <= (p.words.first + p.words.counts)[owner]
            parts = [(near[ok], owner[ok], window)] + [(*p.runs(n), n) for n in lengths]
            found = []
            for places, texts, n in parts:
                a, b = p.hashes(places, n)
                good = in_filter(ends, a)
                found.append((texts[good], places[good], np.full(int(good.sum()), n), a[good], b[good]))
            texts, places, n, a, b = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(texts, kind="stable")
            texts = texts[order]
            start = places[order] - p.words.first[texts]
            values = pa.StructArray.from_arrays(
                [pa.array(start, pa.int32()), pa.array(n[order], pa.int32()), pa.array(a[order].view(np.int64)), pa.array(b[order].view(np.int64))],
                fields=list(place),
            )
            offsets = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=batch.num_rows))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                ["doc_id", "n_words", "places"],
            )

    seen = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, places array<struct<start:int,length:int,a:bigint,b:bigint>>"
    )
    # Row numbers are fixed once the table is written.
    seen = stage(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    places = seen.where(F.size("places") > 0).select("row", F.inline("places"))
    # Stored, so that the join has a plain shuffle on both sides and a passage found all over can be split.
    known = stage(windows.select("item_id", "length", "a", "b").distinct(), "known")
    hits = places.join(known, ["length", "a", "b"])
    return seen.select("row", "doc_id", "n_words"), hits.select("row", "start", "length", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words within any occurrence of an item's window are hit. Null and empty texts have no words and are clean; null and
    wordless items have no window. Repeated rows of either table are treated alike, each document row gives a row and
    equal item ids count once. With no items, or an item with a null id, nothing is added to the item list; words in the
    latter are still hit. Other columns are not read.
    """
    rows, hits = occurrences(docs.select("doc_id", "text"), items.select("item_id", "text"), window, k)
    hits = stage(hits, "hits")
    ids = (
        hits.where("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    spans = hits.groupBy("row", "start").agg((F.col("start") + F.max("length")).alias("stop"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    spans = spans.select("row", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(spans, "row", "left").join(ids, "row", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def without_passages(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns. Null ids are kept apart by row."""
    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows, hits = occurrences(numbered.select(F.col(row).alias("doc_id"), "text"), items.select("item_id", "text"), window, k)
    lost = stage(hits.join(rows.select(F.col("row"), F.col("doc_id").alias(row)), "row").select(row).distinct(), "lost")
    return without_rows(numbered, lost, row).select(*[f"`{c}`" for c in docs.columns])
