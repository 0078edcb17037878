"""Weighted acyclic automata over words: phrase counts built from sorted runs, added up, cut by prefix ranges and composed.

An automaton maps phrases of up to K words to whole numbers. While it is worked on it is a tree in arrays: level d holds
one arc per distinct phrase prefix of d words, sorted by source state and word, and the arc carries the phrase's number (0
where the prefix itself stands for nothing). States of one level are the arcs that lead to them. Stored, it is minimal: states
with equal arcs are one state, found from the last level up by comparing the arcs themselves.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Level = tuple[np.ndarray, np.ndarray, np.ndarray]

_ARC = np.dtype([("word", "<u4"), ("state", "<u4"), ("weight", "<i8")])
_KINDS = ("<u1", "<u2", "<u4", "<u8")


@dataclass(frozen=True)
class Automaton:
    """``words`` is the sorted vocabulary, ``levels`` the arcs (source, word, weight) of each level."""

    words: pa.Array
    levels: list[Level]

    @property
    def arcs(self) -> int:
        return sum(source.size for source, _, _ in self.levels)


def word_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes that lie one after the other in ``data``."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each word in the sorted vocabulary, the vocabulary)."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    return place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), coded.dictionary.take(pa.array(order))


def _level(source: np.ndarray, word: np.ndarray, weight: np.ndarray, n_words: int, add: np.ufunc) -> tuple[Level, np.ndarray]:
    """Sorts arcs, adds up equal ones, and tells which arc each became."""
    key = source * n_words + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if key.size else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    became = np.empty(key.size, np.int64)
    became[order] = np.cumsum(new) - 1
    first = order[begin]
    sums = add.reduceat(weight[order], begin) if begin.size else np.zeros(0, np.int64)
    return (source[first], word[first], sums), became


def from_tokens(tokens: np.ndarray, follows: np.ndarray, words: pa.Array, longest: int) -> Automaton:
    """Counts of all phrases of up to ``longest`` words. ``follows[i]``: token i + 1 stands in the same piece as token i."""
    n = len(words)
    at, state, levels = np.arange(tokens.size), np.zeros(tokens.size, np.int64), []
    for d in range(longest):
        if d:
            reaches = at + d < tokens.size
            at, state = at[reaches], state[reaches]
            joined = follows[at + d - 1]
            at, state = at[joined], state[joined]
        level, state = _level(state, tokens[at + d], np.ones(at.size, np.int64), n, np.add)
        levels.append(level)
    return Automaton(words, levels)


def from_phrases(words: pa.Array, phrases: Sequence[tuple[np.ndarray, np.ndarray]]) -> Automaton:
    """The automaton of (rows of word places, numbers), one entry a phrase length; of equal phrases the greatest number."""
    longest = max((p.shape[1] for p, _ in phrases if len(p)), default=0)
    kept = [(p, w, np.zeros(len(p), np.int64)) for p, w in phrases if len(p)]
    levels = []
    for d in range(longest):
        kept = [(p, w, s) for p, w, s in kept if p.shape[1] > d]
        source = np.concatenate([s for _, _, s in kept])
        word = np.concatenate([p[:, d] for p, _, _ in kept])
        weight = np.concatenate([w if p.shape[1] == d + 1 else np.zeros_like(w) for p, w, _ in kept])
        level, became = _level(source, word, weight, len(words), np.maximum)
        levels.append(level)
        cuts = np.cumsum([len(p) for p, _, _ in kept])[:-1]
        kept = [(p, w, s) for (p, w, _), s in zip(kept, np.split(became, cuts))]
    return trimmed(Automaton(words, levels))


def united(parts: Sequence[Automaton], add: np.ufunc = np.add) -> Automaton:
    """One automaton with all phrases of the parts; numbers of equal phrases are added up (or combined by ``add``)."""
    if len(parts) == 1:
        return parts[0]
    place, words = ranked(pa.concat_arrays([p.words for p in parts]))
    bases = np.cumsum([0] + [len(p.words) for p in parts])
    depth = max((len(p.levels) for p in parts), default=0)
    levels, became = [], None
    for d in range(depth):
        source, word, weight, counts = [], [], [], []
        before = 0
        for p, base in zip(parts, bases):
            own = p.levels[d] if d < len(p.levels) else (np.zeros(0, np.int64),) * 3
            source.append(own[0] if became is None else became[before + own[0]])
            word.append(place[base + own[1]])
            weight.append(own[2])
            before += len(p.levels[d - 1][0]) if 0 < d <= len(p.levels) else 0
        level, became = _level(np.concatenate(source), np.concatenate(word), np.concatenate(weight), len(words), add)
        levels.append(level)
    return Automaton(words, levels)


def trimmed(a: Automaton) -> Automaton:
    """Without the words that no arc bears and without empty levels."""
    levels = [level for level in a.levels if level[0].size]
    used = np.unique(np.concatenate([w for _, w, _ in levels])) if levels else np.zeros(0, np.int64)
    if used.size == len(a.words):
        return Automaton(a.words, levels)
    return Automaton(a.words.take(pa.array(used)), [(s, np.searchsorted(used, w), f) for s, w, f in levels])


def at_least(a: Automaton, least: int) -> Automaton:
    """The phrases with a number of ``least`` or more; other prefixes of these stay as ways with number 0."""
    keep, below = [], None
    for d in range(len(a.levels) - 1, -1, -1):
        own = a.levels[d][2] >= least
        if below is not None:
            own[a.levels[d + 1][0][below]] = True
        keep.append(own)
        below = own
    levels, moved = [], None
    for (source, word, weight), own in zip(a.levels, keep[::-1]):
        source = source[own] if moved is None else moved[source[own]]
        levels.append((source, word[own], np.where(weight[own] >= least, weight[own], 0)))
        moved = np.cumsum(own) - 1
    return trimmed(Automaton(a.words, levels))


def phrases_of(a: Automaton, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of word places, numbers) of the phrases of ``length`` words whose number is not 0, in order."""
    if length > len(a.levels):
        return np.zeros((0, length), np.int64), np.zeros(0, np.int64)
    state = np.flatnonzero(a.levels[length - 1][2])
    weight = a.levels[length - 1][2][state]
    out = np.zeros((state.size, length), np.int64)
    for d in range(length - 1, -1, -1):
        out[:, d] = a.levels[d][1][state]
        state = a.levels[d][0][state]
    return out, weight


def looked_up(a: Automaton, places: np.ndarray) -> np.ndarray:
    """The numbers of phrases given as rows of places in the vocabulary of ``a``; 0 for phrases (and words, -1) it lacks."""
    state = np.zeros(len(places), np.int64)
    found = np.ones(len(places), bool)
    weight = np.zeros(len(places), np.int64)
    for d in range(places.shape[1]):
        if d >= len(a.levels) or not a.levels[d][0].size:
            return np.zeros(len(places), np.int64)
        source, word, f = a.levels[d]
        keys = source * len(a.words) + word
        wanted = state * len(a.words) + places[:, d]
        at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
        found &= (places[:, d] >= 0) & (keys[at] == wanted)
        state, weight = np.where(found, at, 0), f[at]
    return np.where(found, weight, 0)


def places_in(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Where each word stands in the vocabulary, -1 where it does not."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def composed(asked: Automaton, numbers: Automaton) -> Automaton:
    """The phrases of ``asked`` with what ``numbers`` maps them to: both are walked together, level by level."""
    place = places_in(asked.words, numbers.words)
    levels, way = [], np.zeros(1, np.int64)
    for d, (source, word, weight) in enumerate(asked.levels):
        if d >= len(numbers.levels) or not numbers.levels[d][0].size:
            levels.append((source, word, np.zeros_like(weight)))
            way = np.full(source.size, -1)
            continue
        there, label, f = numbers.levels[d]
        keys = there * len(numbers.words) + label
        wanted = way[source] * len(numbers.words) + place[word]
        at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
        found = (way[source] >= 0) & (place[word] >= 0) & (keys[at] == wanted)
        way = np.where(found, at, -1)
        levels.append((source, word, np.where(found & (weight > 0), f[at], 0)))
    return Automaton(asked.words, levels)


# Storing


def _small(values: np.ndarray) -> tuple[int, bytes]:
    """The kind and the bytes of non-negative numbers in the fewest bytes each."""
    most = int(values.max(initial=0))
    kind = next(i for i in range(4) if most < 1 << (8 << i))
    return kind, values.astype(_KINDS[kind]).tobytes()


def to_bytes(a: Automaton) -> bytes:
    """The minimal automaton. States with the same arcs (word, next state, number) become one, whatever their level."""
    register = pa.array([], pa.large_binary())
    state_of = None
    for d in range(len(a.levels) - 1, -1, -1):
        source, word, weight = a.levels[d]
        arcs = np.empty(source.size, _ARC)
        arcs["word"], arcs["weight"] = word, weight
        arcs["state"] = 0 if state_of is None else state_of
        begin = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1]))) if source.size else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, source.size)) * _ARC.itemsize
        coded = pa.concat_arrays([register, word_array(arcs.view(np.uint8), sizes)]).dictionary_encode()
        states = coded.indices.to_numpy(zero_copy_only=False)[len(register) :].astype(np.int64) + 1
        register = coded.dictionary
        n_before = a.levels[d - 1][0].size if d else 1
        state_of = np.zeros(n_before, np.int64)
        state_of[source[begin]] = states
    sizes = pc.binary_length(register).to_numpy(zero_copy_only=False).astype(np.int64) // _ARC.itemsize
    arcs = np.frombuffer(b"".join(register.to_pylist()), _ARC)
    lengths = pc.binary_length(a.words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = b"".join(a.words.to_pylist())
    parts = [_small(x) for x in (lengths, sizes, arcs["word"], arcs["state"], arcs["weight"])]
    root = int(state_of[0]) if state_of is not None else 0
    head = np.array([len(a.levels), root, len(a.words), len(text), sizes.size, arcs.size, *[k for k, _ in parts]], "<i8")
    return head.tobytes() + text + b"".join(x for _, x in parts)


def from_bytes(data: bytes) -> Automaton:
    head = np.frombuffer(data, "<i8", 11).tolist()
    depth, root, n_words, n_text, n_states, n_arcs = head[:6]
    at = 88 + n_text
    text, arrays = np.frombuffer(data, np.uint8, n_text, 88), []
    for kind, n in zip(head[6:], (n_words, n_states, n_arcs, n_arcs, n_arcs)):
        arrays.append(np.frombuffer(data, _KINDS[kind], n, at).astype(np.int64))
        at += n << kind
    lengths, sizes, word, state, weight = arrays
    sizes = np.concatenate(([0], sizes))
    begin = np.cumsum(sizes) - sizes
    levels, here = [], np.array([root])
    for _ in range(depth):
        n = sizes[here]
        source = np.repeat(np.arange(here.size), n)
        arc = np.arange(source.size) + np.repeat(begin[here] - (np.cumsum(n) - n), n)
        levels.append((source, word[arc], weight[arc]))
        here = state[arc]
    return Automaton(word_array(text, lengths), levels)


# Prefix ranges


@dataclass(frozen=True)
class Ranges:
    """Where the order of phrases is cut: ``bounds`` start new ranges of first words; a hot word has a range of its own.

    ``hot`` tells for a range into how many parts the phrases that go on after its one word are cut, by ranges of the next
    word; after two hot words by ranges of the third.
    """

    bounds: tuple[bytes, ...] = ()
    hot: tuple[tuple[int, int], ...] = ()


_WHOLE = Ranges()
_OWN = 1 << 19


def cut(a: Automaton, ranges: Ranges = _WHOLE) -> Iterator[tuple[int, Automaton]]:
    """(range, the automaton of its phrases). Ranges of one phrase are alike in every automaton that is cut by ``ranges``."""
    if not a.levels:
        return
    words = a.words.to_pylist()
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, [bisect_left(words, b) for b in ranges.bounds], 1)
    code, hot, n_codes = np.cumsum(steps)[:-1], dict(ranges.hot), len(ranges.bounds) + 1

    def below(d: int, low: int, high: int) -> tuple[int, int]:
        """The arcs of level d + 1 behind the arcs [low, high) of level d."""
        if d + 1 >= len(a.levels):
            return 0, 0
        return tuple(np.searchsorted(a.levels[d + 1][0], [low, high]).tolist())

    def part(path: Sequence[int], low: int, high: int, deeper: bool) -> Automaton:
        levels = [(np.zeros(1, np.int64), np.array([w]), np.zeros(1, np.int64)) for w in path]
        base = low
        for d in range(len(path), len(a.levels)):
            source, word, weight = a.levels[d]
            start = base if d > len(path) else 0
            own = source[low:high] - start if d > len(path) else np.zeros(high - low, np.int64)
            levels.append((own, word[low:high], weight[low:high]))
            base = low
            low, high = below(d, low, high)
            if not deeper or low == high:
                break
        return trimmed(Automaton(a.words, levels))

    def runs(values: np.ndarray, base: int) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if values.size else np.zeros(1, np.int64)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(values[low]), base + low, base + high

    def split(path: list[int], low: int, high: int, key: int) -> Iterator[tuple[int, Automaton]]:
        """The arcs [low, high) behind the hot words of ``path``."""
        d = len(path)
        mine = code[a.levels[d][1][low:high]]
        times = hot[int(code[path[-1]])]
        digit = 1 + mine * times // n_codes
        if d == 1:
            own = np.isin(mine, list(hot))
            digit = np.where(own, _OWN + mine, digit)
        for value, lo, hi in runs(digit, low):
            at = key | value << (20 if d == 1 else 0)
            if value < _OWN:
                yield at, part(path, lo, hi, True)
                continue
            yield at, part(path, lo, hi, False)
            more = below(d, lo, hi)
            if more[0] < more[1]:
                yield from split([*path, int(a.levels[d][1][lo])], *more, at)

    for value, low, high in runs(code[a.levels[0][1]], 0):
        key = value << 40
        if value not in hot:
            yield key, part([], low, high, True)
            continue
        yield key, part([], low, high, False)
        more = below(0, low, high)
        if more[0] < more[1]:
            yield from split([int(a.levels[0][1][low])], *more, key)


class Sum:
    """Adds up automata as they come, so that no more is held than the sum and a few parts."""

    def __init__(self, add: np.ufunc = np.add, most: int = 1 << 21) -> None:
        self.add, self.most = add, most
        self.waiting: list[Automaton] = []
        self.size = 0

    def take(self, a: Automaton) -> None:
        self.waiting.append(a)
        self.size += a.arcs
        if len(self.waiting) > 1 and self.size > max(self.most, self.waiting[0].arcs):
            self._fold()

    def _fold(self) -> None:
        total = united(self.waiting, self.add)
        self.waiting, self.size = [total], 0

    def total(self) -> Automaton:
        if len(self.waiting) > 1:
            self._fold()
        return self.waiting[0] if self.waiting else Automaton(pa.array([], pa.large_binary()), [])
