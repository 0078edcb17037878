"""Phrases that stand together more often than their parts make likely, from counts kept in weighted acyclic automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import automata as A
from tidemark.llm.frames import pieces, reach_workers, stage
from tidemark.llm.words import LOWER, encoded
from tidemark.operators import ordering

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to ``longest`` words seen ``least`` times or more; a language's best ``limit``.

    A phrase goes if a longer candidate with ``share`` per cent of its count or more holds it. About ``wanted`` words make a prefix
    range, with at most ``most_ranges`` ranges; a task counts ``chunk`` words at a time. These three change no result.
    """

    longest: int = 3
    least: int = 10
    share: int = 50
    limit: int = 2000
    factor: int = 1_000_000
    wanted: int = 1 << 21
    most_ranges: int = 1 << 16
    chunk: int = 1 << 21


class Tokens:
    """Lower-cased words of texts: ``places`` in the sorted vocabulary ``words``, and whether the next word is in the same piece."""

    def __init__(self, data: list[bytes]) -> None:
        buffer = LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
        breaks = _BREAK[buffer]
        inside = ~(breaks | _BLANK[buffer])
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        start, stop = edges[0::2], edges[1::2]
        self.places, self.words = A.ranked(A.word_array(buffer[inside], stop - start))
        piece = np.cumsum(breaks, dtype=np.int64)[start]
        self.follows = np.zeros(start.size, bool)
        self.follows[:-1] = piece[1:] == piece[:-1]

    def chunks(self, most: int, longest: int) -> Iterator[A.Automaton]:
        """Counts of the phrases that start in each run of ``most`` words; a phrase may reach into the next run."""
        for low in range(0, self.places.size, most):
            high = min(low + most, self.places.size)
            tail = min(high + longest - 1, self.places.size)
            follows = self.follows[low:tail].copy()
            counted = A.from_tokens(self.places[low:tail], follows, self.words, longest)
            if tail > high:
                # Phrases that start behind the run belong to the next one.
                over = A.from_tokens(self.places[high:tail], follows[high - low :], self.words, longest)
                counted = _less(counted, over)
            yield A.trimmed(counted)


def _less(a: A.Automaton, b: A.Automaton) -> A.Automaton:
    """``a`` without the counts of ``b``, whose phrases it has."""
    levels = [(s, w, f.copy()) for s, w, f in a.levels]
    for length in range(1, len(b.levels) + 1):
        rows, counts = A.phrases_of(b, length)
        state = np.zeros(len(rows), np.int64)
        for d in range(length):
            source, word, _ = levels[d]
            state = np.searchsorted(source * len(a.words) + word, state * len(a.words) + rows[:, d])
        levels[length - 1][2][state] -= counts
    return A.at_least(A.Automaton(a.words, levels), 1)


def _by_language(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[tuple[str, Tokens]]:
    """The words of each language's texts in a run of rows (language, text)."""
    for batch in pieces(batches, 1, most):
        langs = batch.column(0).dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine = batch.column(1).take(pa.array(np.flatnonzero(which == i)))
            yield lang, Tokens(encoded(mine.to_pylist()))


def _sketches(texts: DataFrame) -> DataFrame:
    """(lang, word, weight): of every run of texts up to 256 words at equal steps of its words in order, with the step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in _by_language(batches):
            counts = np.bincount(tokens.places, minlength=len(tokens.words))
            total = int(counts.sum())
            if not total:
                continue
            step = max(1, -(-total // 256))
            at = np.searchsorted(np.cumsum(counts), np.arange(step, total + step, step).clip(max=total))
            word, times = np.unique(at, return_counts=True)
            names = tokens.words.take(pa.array(word)).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * word.size, pa.string()), names, pa.array(times * step)], ["lang", "word", "weight"]
            )

    return texts.mapInArrow(run, "lang string, word string, weight bigint")


def prefix_ranges(texts: DataFrame, how: Settings) -> dict[str, A.Ranges]:
    """Prefix ranges of about equally many words for each language with more than one range's words.

    Every text is sketched. Only words that end a range or fill one reach the driver: about three a range, and ranges are
    bounded by ``most_ranges``.
    """
    sums = stage(_sketches(texts).groupBy("lang", "word").agg(F.sum("weight").alias("weight")), "sketches")
    total = sums.agg(F.sum("weight")).first()[0] or 0
    wanted = max(how.wanted, -(-total // how.most_ranges))
    if total <= wanted:
        return {}
    told = ordering.running_sum(sums, F.col("weight"), ["word"], ordering.text_slices("word", 1, 2, 4), ["lang"], "upto")
    crosses = F.floor(F.col("upto") / wanted) > F.floor((F.col("upto") - F.col("weight")) / wanted)
    bounds: dict[str, set[bytes]] = {}
    heavy: dict[str, dict[bytes, int]] = {}
    for r in told.where(crosses | (2 * F.col("weight") >= wanted)).collect():
        word = r["word"].encode()
        bounds.setdefault(r["lang"], set()).add(word)
        if 2 * r["weight"] >= wanted:
            bounds[r["lang"]].add(word + b"\0")
            heavy.setdefault(r["lang"], {})[word] = 1 + 2 * r["weight"] // wanted
    out = {}
    for lang, words in bounds.items():
        listed = sorted(words)
        hot = tuple((listed.index(w) + 1, times) for w, times in sorted(heavy.get(lang, {}).items()))
        out[lang] = A.Ranges(tuple(listed), hot)
    return out


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    """(lang, part, source, n, blob)."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "part", "source", "n", "blob"])


_ROW = "lang string, part bigint, source bigint, n bigint, blob binary"


def phrase_counts(texts: DataFrame, ranges, how: Settings) -> DataFrame:
    """(lang, part, source, n, blob): a prefix range's phrases seen ``least`` times or more; ``n`` is its number of words.

    Tasks count runs of words, cut the counts at the ranges and ship minimal automata; each range adds up its own.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in _by_language(batches):
            for counted in tokens.chunks(how.chunk, how.longest):
                for part, own in A.cut(counted, ranges.value.get(lang, A.Ranges())):
                    yield _blobs([(lang, part, 0, int(own.levels[0][2].sum()), A.to_bytes(own))])

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = A.Sum(), 0
        for batch in batches:
            n += pc.sum(batch.column("n")).as_py()
            for blob in batch.column("blob"):
                total.take(A.from_bytes(blob.as_py()))
        yield _blobs([(key[0].as_py(), key[1].as_py(), 0, n, A.to_bytes(A.at_least(total.total(), how.least)))])

    return texts.mapInArrow(shards, _ROW).groupBy("lang", "part").applyInArrow(add_up, _ROW)


def sub_phrases(counted: A.Automaton) -> A.Automaton:
    """All phrases that lie inside a longer one of the automaton, with the greatest number of these."""
    asked = []
    for inner in range(1, len(counted.levels)):
        rows, weights = [], []
        for length in range(inner + 1, len(counted.levels) + 1):
            found, weight = A.phrases_of(counted, length)
            for first in range(length - inner + 1):
                rows.append(found[:, first : first + inner])
                weights.append(weight)
        asked.append((np.concatenate(rows), np.concatenate(weights)))
    return A.from_phrases(counted.words, asked)


def _lasting(counted: A.Automaton, longer: A.Automaton, share: int) -> A.Automaton:
    """The phrases of two words or more that no longer one with ``share`` per cent of their number or more holds."""
    held = A.composed(counted, longer).levels
    levels = []
    for d, ((source, word, weight), (_, _, most)) in enumerate(zip(counted.levels, held)):
        # Compared as shares of hundreds, in parts that stay within 64 bits.
        covered = (weight > 0) & (most > 0) & (_percent(most, weight) >= share)
        levels.append((source, word, np.where(covered | (d == 0), 0, weight)))
    return A.at_least(A.Automaton(counted.words, levels), 1)


def _percent(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    """floor(100 * part / of) for part <= of."""
    if part.size and int(part.max()) >= 1 << 56:
        return np.array([100 * int(p) // max(1, int(o)) for p, o in zip(part, of)], np.int64)
    return 100 * part // np.maximum(of, 1)


def scored(rows: np.ndarray, counts: np.ndarray, parts: A.Automaton, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, score) of the worst cut of each phrase, by whole numbers of any size; ties go to the first cut."""
    best = None
    for k in range(1, rows.shape[1]):
        left, right = A.looked_up(parts, rows[:, :k]), A.looked_up(parts, rows[:, k:])
        if len(rows) and min(left.min(), right.min()) < 1:
            raise RuntimeError("a part of a phrase was not counted")
        wide = counts.astype(object)
        score = (factor * wide * wide // (left.astype(object) * right)).astype(np.int64)
        if best is None:
            best = (left, right, score)
        else:
            worse = score < best[2]
            best = tuple(np.where(worse, new, old) for new, old in zip((left, right, score), best))
    return best


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", how: Settings = Settings()
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and tabs.
    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` all words of the language. Null
    languages count as ``und``; null and empty texts have no words. Repeated rows count again. Equal scores go by ``a``, then
    by the phrase in byte order. Long texts are counted in runs, whole. Other columns are not read. An empty table, or one in
    which nothing is seen ``least`` times, gives an empty result.

    Counts are minimal automata per run of texts, cut at prefix ranges and added up per range. Each range then asks
    the ranges that hold the parts of its candidates (their automata are composed with the counts there), and learns in the
    same exchange which of its candidates a longer one holds.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    ranges = spark.sparkContext.broadcast(prefix_ranges(texts, how))
    counts = stage(phrase_counts(texts, ranges, how), "counts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, own, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
                wanted = sub_phrases(A.from_bytes(blob))
                for part, asked in A.cut(wanted, ranges.value.get(language, A.Ranges())):
                    yield _blobs([(language, part, own, 0, A.to_bytes(asked))])

    def answer(mine: pa.Table, asked: pa.Table) -> pa.Table:
        rows, longer = [], A.Sum(np.maximum)
        if not mine.num_rows:
            raise RuntimeError("a range that is asked has no counts")
        counted = A.from_bytes(mine.column("blob")[0].as_py())
        language, part = mine.column("lang")[0].as_py(), mine.column("part")[0].as_py()
        for source, blob in zip(asked.column("source").to_pylist(), asked.column("blob")):
            question = A.from_bytes(blob.as_py())
            longer.take(question)
            rows.append((language, source, 1, 0, A.to_bytes(A.composed(question, counted))))
        rows.append((language, part, 0, 0, A.to_bytes(_lasting(counted, longer.total(), how.share))))
        return pa.Table.from_batches([_blobs(rows)])

    asked = counts.mapInArrow(ask, _ROW)
    # A row of answers goes back to the range that asked; source 0 is the range's own row of lasting candidates.
    answers = counts.groupBy("lang", "part").cogroup(asked.groupBy("lang", "part")).applyInArrow(answer, _ROW)

    def rate(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, kept = A.Sum(np.maximum), None
        for batch in batches:
            for source, blob in zip(batch.column("source").to_pylist(), batch.column("blob")):
                read = A.from_bytes(blob.as_py())
                if source:
                    parts.take(read)
                else:
                    kept = read
        known = parts.total()
        words = kept.words.to_pylist()
        place = A.places_in(kept.words, known.words)
        found = []
        for length in range(2, len(kept.levels) + 1):
            rows, a = A.phrases_of(kept, length)
            if len(rows):
                left, right, score = scored(place[rows], a, known, how.factor)
                names = [b" ".join([words[w] for w in row]) for row in rows.tolist()]
                found += zip((-score).tolist(), (-a).tolist(), names, left.tolist(), right.tolist())
        # No language has more of its best in this range than it has in all.
        found = sorted(found)[: how.limit]
        columns = list(zip(*found)) if found else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0].as_py()] * len(found), pa.string()),
                pa.array([n.decode() for n in columns[2]], pa.string()),
                pa.array([-x for x in columns[1]], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.int64()),
                pa.array([-x for x in columns[0]], pa.int64()),
            ],
            ["lang", "phrase", "a", "l", "r", "score"],
        )

    rated = answers.groupBy("lang", "part").applyInArrow(rate, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = rated.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= how.limit)
    words = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
