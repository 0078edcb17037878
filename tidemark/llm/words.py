"""Words of many texts as flat numpy arrays, hashed without a loop over words.

Two word rules are used by the operators. ``LETTERS`` takes runs of ASCII letters, digits and anything beyond ASCII;
``SOLID`` takes runs without ASCII white space. Both lower-case A-Z only. Rules are bytewise, which equals the
character rule because every byte of a character beyond ASCII is itself beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
SOLID = np.ones(256, dtype=bool)
SOLID[[32, *range(9, 14)]] = False

#: For bytes.translate: words of the LETTERS rule lower-cased, all else a space.
LETTERS_TABLE = bytes(int(LOWER[i]) if LETTERS[i] else 32 for i in range(256))

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(kind)
    if have is None or have.size < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


class Words:
    """The words of a batch of texts.

    ``buffer`` holds all bytes lower-cased, ``start`` and ``end`` the words' places in it, ``counts`` the number of words
    of each text and ``first`` the index of its first word.
    """

    def __init__(self, data: Sequence[bytes], rule: np.ndarray) -> None:
        self.data = data
        joined = b"\n".join(data) + b"\n"
        self.buffer = LOWER[np.frombuffer(joined, dtype=np.uint8)]
        inside = rule[self.buffer]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(x) + 1 for x in data), np.int64, len(data))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.bounds = bounds
        places = np.searchsorted(self.start, bounds)
        self.first, self.counts = places[:-1], np.diff(places)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = self.buffer.size
        sums = np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1 + seed)) * _power("up", _BASE, n), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), sums))
        own = (sums[self.end] - sums[self.start]) * _power("down", _INVERSE, n)[self.start]
        return mix(own ^ (self.end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.data)), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by the run's first word; runs may cross texts."""
    n = max(0, hashes.size - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
