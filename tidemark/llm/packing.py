"""Packing token sequences: the length histogram is packed shortest pack first, its patterns are joined back by rank."""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import pieces as slices
from tidemark.llm.frames import reach_workers, stage
from tidemark.llm.words import LOWER, encoded
from tidemark.operators import ordering

#: ASCII white space: no token, no rule of the supported tokenizers reaches across it.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
#: Marks that are cut from the end of a unit, what must stand before them, and what keeps a unit from being lower-cased.
_MARK, _ALNUM, _ODD = np.zeros((3, 256), dtype=bool)
_MARK[[*b".,;:!?"]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ODD[[*b"<", *range(128, 256)]] = True
#: Units and ids that a worker remembers before it starts afresh.
_REMEMBERED, _IDS = 1 << 19, 1 << 22


@dataclass(frozen=True)
class Settings:
    """Sequences hold ``size`` tokens; each document ends with ``end``."""

    size: int = 2048
    end: int = 1


@dataclass(frozen=True)
class Slots:
    """Pieces of one length by rank: those in [low, high) go ``times`` to a sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    low: int
    high: int
    sequence: int
    offset: int
    times: int


def pack_histogram(counts: dict[int, int], size: int) -> list[Slots]:
    """Patterns for ``counts[length]`` pieces of each length, longest first, each into the packs with most room left.

    A group of packs with one pattern is one entry: a length takes as many packs of the roomiest group as it has pieces,
    what is left of the group keeps its pattern. Only where no pack has room are new ones opened, each with as many of
    the pieces as it holds. The work depends on the number of lengths, at most ``size``, not on the number of pieces.
    """
    room: list[tuple[int, int, int, tuple]] = []  # (-room, order, packs, pattern); a pattern is a chain of (length, times)
    order = itertools.count()
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit {size}")
        left = counts[length]
        while left:
            if room and -room[0][0] >= length:
                space, _, packs, pattern = heapq.heappop(room)
                taken = min(packs, left)
                if packs > taken:
                    heapq.heappush(room, (space, next(order), packs - taken, pattern))
                heapq.heappush(room, (space + length, next(order), taken, _with(pattern, length, 1)))
                left -= taken
                continue
            fits = size // length
            packs, rest = divmod(left, fits)
            if packs:
                heapq.heappush(room, (fits * length - size, next(order), packs, _with((), length, fits)))
            if rest:
                heapq.heappush(room, (rest * length - size, next(order), 1, _with((), length, rest)))
            left = 0
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for _, _, packs, pattern in sorted(room, key=lambda r: r[:2]):
        offset = 0
        for length, times in _listed(pattern):
            low = used.get(length, 0)
            high = used[length] = low + packs * times
            slots.append(Slots(length, low, high, sequence, offset, times))
            offset += length * times
        sequence += packs
    return slots


def _with(pattern: tuple, length: int, times: int) -> tuple:
    """The chain with more pieces at its end; equal lengths are one link."""
    if pattern and pattern[1] == length:
        return (pattern[0], length, pattern[2] + times)
    return (pattern, length, times)


def _listed(pattern: tuple) -> list[tuple[int, int]]:
    out = []
    while pattern:
        pattern, length, times = pattern
        out.append((length, times))
    return out[::-1]


class UnitEncoder:
    """Ids of texts by a public tokenizer that never joins characters across white space.

    Texts are cut at ASCII white space into units, and a mark behind a letter or digit at the end of a unit is a unit of its
    own, as no rule joins the two. Each distinct unit of a slice is encoded once; the ids of the texts are gathered from
    those of their units. Units in ASCII count in lower case (but for those with ``<``, which special tokens hold). ``json`` is
    the tokenizer's file. Tokenizers with other rules are refused.
    """

    def __init__(self, json: str) -> None:
        # Spark's tasks are the parallel part; threads of the tokenizer would only compete with them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        split = (lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids)
        if split("Ab  cd.\n e9!") != split("ab") + split("cd") + split(".") + split("e9") + split("!"):
            raise ValueError("the tokenizer tells case or white space apart or joins words or marks")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self._keep({}, np.zeros(0, bool))

    def _keep(self, known: dict[bytes, int], kept: np.ndarray) -> None:
        """Remembers only the units whose places are kept."""
        new_place = np.cumsum(kept) - 1
        count = self.count[: kept.size][kept] if kept.any() else np.zeros(0, np.int64)
        begin = np.cumsum(count) - count
        flat = self.flat[np.arange(int(count.sum())) + np.repeat(self.begin[: kept.size][kept] - begin, count)] if kept.any() else None
        self.known = {u: int(new_place[i]) for u, i in known.items() if kept[i]}
        self.begin, self.count = _grown(begin, 1 << 12), _grown(count, 1 << 12)
        self.flat = _grown(flat if flat is not None else np.zeros(0, np.uint32), 1 << 14)
        self.used = np.zeros(self.begin.size, np.int8)
        self.n, self.filled = count.size, int(count.sum())

    def _learn(self, units: list[bytes]) -> None:
        """Adds units that are not known. Those that only differ in the case of Latin letters share their ids."""
        plain = [_lowered(u) for u in units]
        fresh = list(dict.fromkeys(p for p in plain if p not in self.known))
        texts = [u.decode("utf-8", "surrogatepass") for u in fresh]
        # A unit of letters is one word of the tokenizer, so its ids end where one ends a word: such units go together.
        letters = [t.isalpha() and (t.isascii() or max(t) < "\u0100") for t in texts]
        single = list(itertools.compress(texts, letters))
        ids, sizes = self._of_words(single)
        others = [i for i, own in enumerate(letters) if not own]
        encoding = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in others], add_special_tokens=False)]
        ids = np.concatenate((ids, np.fromiter(itertools.chain.from_iterable(encoding), np.uint32)))
        sizes = np.concatenate((sizes, np.fromiter(map(len, encoding), np.int64, len(encoding))))
        fresh = [*itertools.compress(fresh, letters), *(fresh[i] for i in others)]
        total, last = ids.size, self.n + len(fresh)
        self.flat = _grown(self.flat, self.filled + total)
        self.begin, self.count, self.used = (_grown(x, last + len(units)) for x in (self.begin, self.count, self.used))
        self.begin[self.n : last] = self.filled + np.cumsum(sizes) - sizes
        self.count[self.n : last] = sizes
        self.flat[self.filled : self.filled + total] = ids
        self.filled += total
        self.known.update(zip(fresh, range(self.n, last)))
        for unit, p in zip(units, plain):
            if unit not in self.known:
                at = self.known[p]
                self.begin[last], self.count[last] = self.begin[at], self.count[at]
                self.known[unit] = last
                last += 1
        self.n = last

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of units that are one word each."""
        lines = [" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]
        encoding = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in encoding), np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if sizes.size != len(words):
            raise RuntimeError("the tokenizer's words do not end where its units end")
        return ids, sizes

    def _forget(self) -> None:
        """Forgets units seen in one slice only, or all if that is not enough."""
        kept = self.used[: self.n] > 1
        if 2 * int(kept.sum()) > _REMEMBERED or 2 * int(self.count[: self.n][kept].sum()) > _IDS:
            kept[:] = False
        self._keep(self.known, kept)

    def encode(self, data: Sequence[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); every text ends with ``end``."""
        joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        inside = ~_BLANK[joined]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        start, stop = edges[0::2], edges[1::2]
        bounds = np.cumsum(np.fromiter((len(x) + 1 for x in data), np.int64, len(data)))
        size = stop - start
        odd = np.concatenate(([0], np.cumsum(_ODD[joined], dtype=np.int64)))
        odd = odd[stop] > odd[start]
        letters = joined[inside]
        letters = np.where(np.repeat(odd, size), letters, LOWER[letters])
        cut = (size > 1) & _MARK[joined[stop - 1]] & _ALNUM[joined[stop - 2]]
        several = 1 + cut.astype(np.int64)
        places = np.concatenate(([0], np.cumsum(several)))
        sizes = np.ones(places[-1], np.int64)
        sizes[places[:-1]] = size - cut
        upto = places[np.searchsorted(start, bounds)]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        units = pa.Array.from_buffers(pa.large_binary(), sizes.size, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if self.n + len(distinct) > _REMEMBERED or self.filled > _IDS:
            self._forget()
        fresh = [u for u in distinct if u not in self.known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter((self.known[u] for u in distinct), np.int64, len(distinct))
        self.used[place] = np.minimum(self.used[place] + 1, 2)
        which = place[units.indices.to_numpy()] if sizes.size else np.zeros(0, np.int64)
        count = self.count[which]
        # Every text has one more id, its end.
        sums = np.concatenate(([0], np.cumsum(count)))
        per_text = np.diff(sums[np.concatenate(([0], upto))]) + 1
        out = np.empty(int(per_text.sum()), np.uint32)
        last = np.cumsum(per_text) - 1
        own = np.ones(out.size, bool)
        own[last] = False
        out[last] = end
        shift = np.repeat(self.begin[which] - sums[:-1], count)
        out[own] = self.flat[np.arange(int(sums[-1])) + shift]
        return out, per_text


def _lowered(unit: bytes) -> bytes:
    """A unit of Latin-1 letters and signs in lower case; all others, and those with ``<``, as they are."""
    if unit.isascii() or b"<" in unit:
        return unit
    text = unit.decode("utf-8", "surrogatepass")
    return text.lower().encode() if max(text) < "\u0100" else unit


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    if array.size >= n:
        return array
    out = np.zeros(max(n, 2 * array.size), array.dtype)
    out[: array.size] = array
    return out


_encoders: dict[int, UnitEncoder] = {}


def _encoder(json: str) -> UnitEncoder:
    """One encoder a worker process and tokenizer."""
    key = zlib.crc32(json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = UnitEncoder(json)
    return _encoders[key]


def cut_documents(docs: DataFrame, tokenizer: str, id_column: str, text: str, how: Settings, ids: bool) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids in pieces of at most ``size``."""
    reach_workers(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        json = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(json.value)
        for batch in slices(batches, 1, 1 << 22):
            flat, counts = encoder.encode(encoded(batch.column(1).to_pylist()), how.end)
            n_pieces = -(-counts // how.size)
            owner = np.repeat(np.arange(counts.size), n_pieces)
            start = (np.arange(owner.size) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * how.size
            length = np.minimum(counts[owner] - start, how.size)
            begin = (np.cumsum(counts) - counts)[owner] + start
            data = memoryview(flat.astype("<u4").tobytes())
            parts = [data[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
            columns = [
                batch.column(0).take(pa.array(owner)),
                pa.array(start),
                pa.array(length),
                pa.array(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))),
                pa.array(counts[owner]),
            ]
            if ids:
                columns.append(pa.array(map(bytes, parts), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=None, names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, schema)


def packed(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", how: Settings = Settings(), ids: bool = False
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row of ``docs`` is a document of its own, also where ids or texts repeat; a null id stays null, a null or empty
    text has the end id only. A document of more than ``size`` ids is cut at multiples of ``size``, whatever its length.
    Sequences are numbered from 0 without gaps, as are the tokens in each. Other columns are not read; an empty table
    gives an empty result. With ``ids`` the pieces carry their ids as little-endian 32-bit integers (see ``sequences``).

    Only the histogram of lengths, at most ``size`` rows, reaches the driver. The slots made of it depend on the lengths
    alone and number at most a few per length and pattern. Pieces are numbered within their length over slices of their arrival,
    so a length that a third of all pieces has is not one task's. Equal lengths are dealt in the order of arrival.
    """
    spark = docs.sparkSession
    cut = cut_documents(docs, tokenizer, id_column, text, how, ids)
    cut = stage(cut.withColumn("_at", F.monotonically_increasing_id()), "cut")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = pack_histogram(counts, how.size)
    names = ["length", "_low", "_high", "_sequence", "_offset", "_times"]
    table = spark.createDataFrame(
        [(s.length, s.low, s.high, s.sequence, s.offset, s.times) for s in slots], ", ".join(f"{n} bigint" for n in names)
    )
    ranked = ordering.number_rows(cut, ["_at"], ordering.int_slices("_at", 33, 14), ["length"], "_rank")
    nth = F.col("_rank") - 1 - F.col("_low")
    return (
        ranked.join(F.broadcast(table), "length")
        .where((F.col("_rank") > F.col("_low")) & (F.col("_rank") <= F.col("_high")))
        .select(
            F.col("id").alias(id_column),
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            (F.col("_sequence") + F.floor(nth / F.col("_times"))).cast("bigint").alias("sequence_id"),
            (F.col("_offset") + F.pmod(nth, F.col("_times")) * F.col("length")).cast("bigint").alias("offset"),
            *(["ids"] if ids else []),
        )
    )


def sequences(pieces: DataFrame, size: int = Settings.size) -> DataFrame:
    """(sequence_id, n_tokens, padded_to, ids) of pieces that carry their ids: one row per sequence.

    ``ids`` are the ids of its pieces in order, little-endian 32-bit integers without padding. ``padded_to`` is the length
    itself at a power of two, else ``size``. A sequence has at most ``size`` pieces, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    n = F.sum("length")
    return pieces.groupBy("sequence_id").agg(
        n.alias("n_tokens"),
        F.when(F.bit_count(n) == 1, n).otherwise(F.lit(size)).cast("bigint").alias("padded_to"),
        F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"),
    )
