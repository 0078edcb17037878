"""Piece encoding and decoding with a byte-pair model file, by rounds of merges over flat arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tidemark.llm.frames import pieces as slices
from tidemark.llm.frames import reach_workers

_NONE = np.int32(1 << 30)
_SPACE = "▁"
_UNITS = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
_LINE_UNITS = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n")
#: Units of more symbols are merged with a heap: rounds would walk them once per symbol.
_LONG = 64
#: Units whose ids a worker remembers; beyond that it starts afresh.
_REMEMBERED = 100_000


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model file; its size is that of the vocabulary, not of the data."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes  # n(ormal), b(yte), c(ontrol), u(nknown)
    begin: int
    end: int


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a byte-pair model with byte pieces and unchanged text; others are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = "".join(
        "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) or model.is_unused(i) else "n"
        for i in range(n)
    )
    names = tuple(model.id_to_piece(i) for i in range(n))
    if kinds.count("b") != 256:
        raise ValueError("the model has no byte pieces")
    if any(_SPACE in p.lstrip(_SPACE) for p, k in zip(names, kinds) if k == "n"):
        raise ValueError("the model has pieces with a space inside")
    return Vocabulary(names, tuple(model.get_score(i) for i in range(n)), kinds.encode(), model.bos_id(), model.eos_id())


class Encoder:
    """Encodes units (a run of spaces with the characters up to the next space) into ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        normal = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i : i + 1] == b"n"}
        # Symbols that only occur inside longer pieces get ids of their own beyond the vocabulary.
        n = len(vocabulary.pieces)
        inner = sorted({c for p in normal for c in p} - set(normal))
        self.symbols = normal | {c: n + i for i, c in enumerate(inner)}
        self.n, self.inner = n + len(inner), inner
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.bytes_of = {b: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k == 98 for b in [int(p[3:5], 16)]}
        distinct = sorted({vocabulary.scores[i] for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(distinct)}
        self.pairs = {
            (self.symbols[p[:c]], self.symbols[p[c:]]): (rank[vocabulary.scores[i]], i)
            for p, i in normal.items()
            for c in range(1, len(p))
            if p[:c] in self.symbols and p[c:] in self.symbols
        }
        self._table()
        # A line break that no piece holds never merges, so units may end there.
        self.cut = _UNITS if any("\n" in p for p in self.symbols) else _LINE_UNITS
        self.known: dict[str, bytes] = {}

    def _table(self) -> None:
        """An open-addressing table of the pairs, looked up for many pairs at once."""
        self.mask = (1 << max(4, (8 * len(self.pairs)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, dtype=np.int32)
        self.made = np.full(self.mask + 1, -1, dtype=np.int32)
        for (a, b), (rank, made) in self.pairs.items():
            key = a * self.n + b
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 12) & self.mask

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; pairs that never merge have rank ``_NONE``."""
        key = left.astype(np.int64) * self.n + right
        at = self._slot(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], _NONE), self.made[at]

    def merge_rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no pair remains; ``sizes`` are the units' lengths, none zero. Returns symbols and sizes.

        In each round every unit merges the leftmost of its pairs of least rank, all units at once. Units without a
        pair leave the arrays, the others are compacted.
        """
        n_units = sizes.size
        unit = np.repeat(np.arange(n_units), sizes)
        out_symbols, out_units = [], []
        follows = np.concatenate((unit[1:] == unit[:-1], [False])) if unit.size else np.zeros(0, bool)
        rank, made = np.full(symbols.size, _NONE, np.int32), np.zeros(symbols.size, np.int32)
        at = np.flatnonzero(follows)
        rank[at], made[at] = self.look_up(symbols[at], symbols[at + 1])
        while symbols.size:
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.concatenate((first, [symbols.size])))
            done = np.repeat(least == _NONE, lengths)
            if done.any():
                out_symbols.append(symbols[done])
                out_units.append(unit[done])
                left = ~done
                symbols, unit, rank, made = symbols[left], unit[left], rank[left], made[left]
                keep = least != _NONE
                least, lengths = least[keep], lengths[keep]
                if not symbols.size:
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            at = at[np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))]
            symbols[at] = made[at]
            stay = np.ones(symbols.size, dtype=bool)
            stay[at + 1] = False
            at = at - np.arange(at.size)  # places after the compaction
            symbols, unit, rank, made = symbols[stay], unit[stay], rank[stay], made[stay]
            for change in (at, at[at > 0] - 1):
                with_next = change[change + 1 < symbols.size]
                with_next = with_next[unit[with_next] == unit[with_next + 1]]
                rank[change] = _NONE
                rank[with_next], made[with_next] = self.look_up(symbols[with_next], symbols[with_next + 1])
        if not out_units:
            return symbols, np.zeros(n_units, np.int64)
        units = np.concatenate(out_units)
        order = np.argsort(units, kind="stable")
        return np.concatenate(out_symbols)[order], np.bincount(units, minlength=n_units)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one long unit, by a heap of (rank, place)."""
        n = len(symbols)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (found := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], j, found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, j, made = heapq.heappop(heap)
            if not alive[i] or after[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s, ok in zip(symbols, alive) if ok]

    def _ids(self, symbols: Sequence[int], characters: str) -> bytes:
        """Little-endian ids of a unit; characters the model lacks become byte ids."""
        if all(0 <= s < len(self.v.pieces) for s in symbols):
            return np.asarray(symbols, dtype="<u4").tobytes()
        out, place = [], 0
        for s in symbols:
            text = characters[place] if s < 0 else self.v.pieces[s] if s < len(self.v.pieces) else self.inner[s - len(self.v.pieces)]
            place += len(text)
            out.extend([s] if 0 <= s < len(self.v.pieces) else [self.bytes_of[b] for b in text.encode("utf-8", "surrogatepass")])
        return np.asarray(out, dtype="<u4").tobytes()

    def learn(self, units: Sequence[str]) -> None:
        """Encodes units that are not yet known."""
        short = [u for u in units if len(u) <= _LONG]
        for u in units:
            if len(u) > _LONG:
                symbols = self.of_char[np.frombuffer(u.encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
                self.known[u] = self._ids(self.merge_long(symbols), u)
        if not short:
            return
        points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols, sizes = self.merge_rounds(self.of_char[points], np.fromiter(map(len, short), np.int64, len(short)))
        ends = np.cumsum(sizes)
        plain = np.minimum.reduceat(symbols, ends - sizes) >= 0
        plain &= np.maximum.reduceat(symbols, ends - sizes) < len(self.v.pieces)
        raw = symbols.astype("<u4").tobytes()
        for u, ok, low, high in zip(short, plain.tolist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist()):
            self.known[u] = raw[low:high] if ok else self._ids(symbols[low // 4 : high // 4].tolist(), u)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian ids of each text, with begin and end ids."""
        if len(self.known) > _REMEMBERED:
            self.known = {}
        cut = self.cut.findall
        units = [cut(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        self.learn(list({u for text in units for u in text} - self.known.keys()))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.v.begin, self.v.end))
        known = self.known.__getitem__
        return [b"".join([begin, *map(known, text), end]) for text in units]


#: Encoders of this worker by model path; later tasks find the units already known.
_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, vocabulary: Vocabulary) -> Encoder:
    key = (path, hash(vocabulary))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == 98 else b"" if k == 99 else " ⁇ ".encode() if k == 117 else p.replace(_SPACE, " ").encode()
            for p, k in zip(vocabulary.pieces, vocabulary.kinds)
        ]
        self.control = {i for i, k in enumerate(vocabulary.kinds) if k == 99}

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        data = b"".join(map(self.bytes_of.__getitem__, numbers))
        first = next((i for i in numbers if i not in self.control), None)
        # The space put before the text is taken off again.
        if first is not None and self.bytes_of[first][:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _mapped(docs: DataFrame, column: str, name: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    """``docs`` with one more column ``name`` made from ``column`` a slice of rows at a time; a column of that name goes."""
    reach_workers(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{column}`").alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, len(others)):
            made = pa.array(work(batch.column(len(others)).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*[f.name for f in others], name])

    return frame.mapInArrow(run, T.StructType([*others, T.StructField(name, kind)]))


def encode_pieces(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The rows with a binary column ``name``: the text's ids as little-endian unsigned 32-bit integers.

    Ids equal those of the public library for the model at ``path``, with begin and end ids and without sampling. Whole
    texts are encoded whatever their length; null counts as empty, which is the begin and the end id alone. A column
    called ``name`` is replaced, all others are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    return _mapped(docs, text, name, T.BinaryType(), pa.binary(), lambda: _encoder(path, sent.value).encode)


def decode_pieces(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with a text column ``name``: what the ids stand for. Null ids give null."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def make():
        decoder = Decoder(sent.value)
        return lambda rows: [decoder.decode(r) for r in rows]

    return _mapped(docs, ids, name, T.StringType(), pa.string(), make)


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids encoded, then decoded from the ids."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def make():
        encoder, decoder = _encoder(path, sent.value), Decoder(sent.value)
        return lambda texts: [{"ids": ids, "decoded": decoder.decode(ids)} for ids in encoder.encode(texts)]

    # Both in one pass: one Python worker a task instead of two.
    arrow = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
    coded = _mapped(docs.select("doc_id", F.col("text").alias("coded")), "coded", "coded", kind, arrow, make).select("doc_id", "coded.*")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
