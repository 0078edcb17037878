"""Near-duplicate groups: SimHash fingerprints joined with themselves in binary tries, and sets of shingles by their similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import at_least, free_name, may_be_in, pieces, reach_workers, remove, stage, store, without_rows
from tidemark.llm.words import SOLID, Words, encoded, mix

_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Fingerprints:
    """How texts become fingerprints: words in a shingle, bits, and the seed of the shingle's XXH64."""

    shingle: int = 3
    bits: int = 64
    seed: int = 42


@dataclass(frozen=True)
class Search:
    """How tries are walked. Two fingerprints link at ``budget`` or fewer differing bits of all their bits.

    Each of ``tries`` tries starts at another bit. Partners must agree on a trie's first bits, as many as the number of
    fingerprints asks for but at most bits / tries, and differ in at most ``early`` of its first ``depth`` bits.
    With tries = budget + 1, early = budget and depth = 64 some trie has every linked pair (a pair differs in no bit of
    at least one of budget + 1 blocks), so the search is exact. Fewer tries than that trade recall for work; they set
    ``first``, the bits that partners agree on in a trie, so that the recall is the same for any number of fingerprints.
    Node pairs of at most ``leaf`` pairs of fingerprints are compared, not walked further.
    """

    budget: int = 2
    tries: int = 3
    early: int = 2
    depth: int = 64
    first: int | None = None
    leaf: int = 32


EXACT = Search()


@dataclass(frozen=True)
class Similar:
    """Which texts are near: sets of distinct ``shingle``-word runs with a Jaccard similarity of at least ``share`` / 10.

    Texts are compared if links of a trie search connect the SimHash fingerprints of their sets, ``bits`` long. At a similarity
    of 0.8 a bit differs with probability 0.151 (0.1875 for sets of four and five), so by the binomial law the search links
    more than 99.99 % of such pairs itself (99.7 %), more above, whatever the number of texts.

    ``bands`` and ``rows`` are those of ``band_keys``, which no search uses.
    """

    shingle: int = 5
    seed: int = 42
    share: int = 8
    bands: int = 24
    rows: int = 5
    bits: int = 256
    search: Search = Search(budget=72, tries=32, early=5, depth=24, first=8, leaf=1 << 16)


SIMILAR = Similar()

#: Fingerprints wanted in a task of the join, and the most of one trie node before it is split over several tasks.
_WANTED, _MOST = 4_000, 60_000

#: Rows and shingles of a chunk of texts whose sets are compared in one task, and the rows that every chunk is compared with.
_ROWS, _ELEMENTS, _HEADS = 1_024, 1_000_000, 4


def shingles_of(data: list[bytes], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of each run of ``k`` words, text after text, and how many each text has. Fewer words are one run."""
    words = Words(data, SOLID)
    joined = b" ".join(b" ".join(words.buffer[b:e].tobytes().split()) for b, e in zip(words.bounds[:-1], words.bounds[1:]))
    # In ``joined`` the words follow each other with one space between, so a shingle is one slice of it.
    size = words.end - words.start
    begin, where = _places(joined, size)
    last = begin + size
    counts = np.where(words.counts == 0, 0, np.maximum(1, words.counts - k + 1))
    if where is not None:
        raise ValueError(where)
    first = np.repeat(words.first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    stop = np.minimum(first + k - 1, np.repeat(words.first + words.counts - 1, counts))
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(begin[first].tolist(), last[stop].tolist())), np.uint64, first.size
    )
    return hashed, counts


def fingerprints_of(data: list[bytes], how: Fingerprints) -> np.ndarray:
    """The fingerprints of texts as rows of big-endian 64-bit words."""
    return majorities(*shingles_of(data, how.shingle, how.seed), how.bits)


def majorities(hashed: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of ``bits`` bits as rows of 64-bit words, of hashes text after text and how many each text has."""
    out = np.zeros((counts.size, bits // 64), dtype=np.uint64)
    for w in range(bits // 64):
        out[:, w] = _majority(hashed if w == 0 else mix(hashed ^ np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))), counts)
    return out


def as_binary(values: np.ndarray) -> pa.Array:
    """Fingerprints as binary values, the most significant byte first."""
    rows, width = values.astype(">u8").tobytes(), 8 * values.shape[1]
    return pa.array([rows[i : i + width] for i in range(0, len(rows), width)], pa.binary())


def _places(joined: bytes, size: np.ndarray) -> tuple[np.ndarray, str | None]:
    """Where each word starts in the joined words. Texts without words leave an extra space behind."""
    inside = SOLID[np.frombuffer(joined, dtype=np.uint8)] if joined else np.zeros(0, bool)
    begin = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    return begin, None if begin.size == size.size else "words do not line up"


def _majority(hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes; zero where it has none.

    Eight bits are counted at once in the byte lanes of a word, over runs of at most 255 hashes.
    """
    out = np.zeros(counts.size, dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    n = counts[full]
    parts = -(-n // 255)
    part_of = np.repeat(np.arange(full.size), parts)
    nth = np.arange(part_of.size) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * nth
    groups = np.cumsum(parts) - parts
    for bit in range(8):
        lanes = np.add.reduceat((hashed >> np.uint64(bit)) & _LANES, begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        over = (2 * sums > n[:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def with_fingerprints(docs: DataFrame, text: str, how: Fingerprints, name: str) -> DataFrame:
    """The rows without their text, with a binary column ``name``: the fingerprint, most significant byte first.

    Null and empty texts have fingerprint zero. Whole texts are used.
    """
    reach_workers(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    frame = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    schema = frame.schema
    out_schema = type(schema)(schema.fields[:-1]).add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(others)):
            column = as_binary(fingerprints_of(encoded(batch.column(len(others)).to_pylist()), how))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*others, name])

    return frame.mapInArrow(run, out_schema)


def trie_keys(values: np.ndarray, start: int) -> np.ndarray:
    """The 64 bits of each fingerprint from bit ``start`` on, counted from the most significant and wrapping round."""
    n = values.shape[1]
    w, shift = divmod(start % (64 * n), 64)
    key = values[:, w] << np.uint64(shift)
    return key if not shift else key | (values[:, (w + 1) % n] >> np.uint64(64 - shift))


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each item's label is the least index of its set."""
    labels = labels.copy()
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def differing(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[a] ^ values[b]).sum(axis=1, dtype=np.int64)


def join_tries(
    values: np.ndarray, side: np.ndarray, start: int, level: int, diff: int, search: Search, chunk: int = 100_000
) -> np.ndarray:
    """Walks the pair of trie nodes that hold the fingerprints of side 0 and of side 1; labels linked sets.

    ``level`` bits are already walked with ``diff`` differences; where all rows are of side 0 the node is paired with
    itself. Node pairs are ranges of the sorted keys. A pair is dropped once its bits differ in more than the budget
    allows, or when both nodes hold nothing but one linked set already. Node pairs wait on a stack and are taken
    ``chunk`` at a time, so memory is bounded by the depth, not by the number of pairs.
    """
    order = np.lexsort((trie_keys(values, start), side))
    values, n0 = values[order], int((side == 0).sum())
    keys, n = trie_keys(values, start), order.size
    labels = np.arange(n)
    # Neighbours in key order are linked first: sets of copies then become pure ranges and are not walked.
    for gap in (1, 2, 3):
        a = np.arange(n - gap) if n > gap else np.zeros(0, np.int64)
        a = a[differing(values, a, a + gap) <= search.budget] if a.size else a
        labels = merge(labels, a, a + gap)
    pure = _pure_until(labels)
    own = n0 == n
    beyond = 0 if own else n0
    stack = [(np.array([[0, n0, beyond, n]]), np.array([diff]), level)] if n else []
    while stack:
        nodes, diffs, depth = stack.pop()
        if len(nodes) > chunk:
            stack.append((nodes[chunk:], diffs[chunk:], depth))
            nodes, diffs = nodes[:chunk], diffs[:chunk]
        a0, a1, b0, b1 = nodes.T
        same = (pure[a0] >= a1) & (pure[b0] >= b1) & (labels[a0] == labels[b0])
        size = (a1 - a0) * (b1 - b0)
        leaf = ~same & ((size <= search.leaf) | (depth >= search.depth))
        if leaf.any():
            before = labels
            pairs = _leaf_pairs(nodes[leaf], own) if search.leaf <= 32 else _early_pairs(nodes[leaf], (keys >> np.uint64(64 - search.depth)).astype(np.uint32), search)
            for x, y in pairs:
                ok = differing(values, x, y) <= search.budget
                labels = merge(labels, x[ok], y[ok])
            if labels is not before and (labels != before).any():
                pure = _pure_until(labels)
        inner = ~same & ~leaf
        if not inner.any():
            continue
        a0, a1, b0, b1, d = a0[inner], a1[inner], b0[inner], b1[inner], diffs[inner]
        am, bm = _split(keys[:n0], 0, a0, a1, depth), _split(keys[beyond:], beyond, b0, b1, depth)
        twin = (a0 == b0) & (a1 == b1)
        children = np.concatenate(
            [np.stack(x, 1) for x in ((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm))]
        )
        d = np.concatenate((d, d, d + 1, d + 1))
        keep = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (d <= search.early)
        keep[3 * twin.size :] &= ~twin
        if keep.any():
            stack.append((children[keep], d[keep], depth + 1))
    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def _pure_until(labels: np.ndarray) -> np.ndarray:
    """For each place, where the run of equal labels around it ends."""
    ends = np.flatnonzero(np.concatenate((labels[1:] != labels[:-1], [True]))) + 1 if labels.size else labels
    return ends[np.searchsorted(ends, np.arange(labels.size), side="right")] if labels.size else labels


def _split(keys: np.ndarray, base: int, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where in each range the bit at ``depth`` becomes one; ``keys`` are the sorted keys from place ``base`` on."""
    bit = np.uint64(63 - depth)
    middle = (keys[low - base] >> bit | np.uint64(1)) << bit
    return np.clip(base + np.searchsorted(keys, middle), low, high)


def _leaf_pairs(nodes: np.ndarray, own: bool, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the leaf node pairs, at most about ``most`` at a time; within one node each pair once."""
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    cut = np.cumsum(sizes) // most
    for part in np.unique(cut):
        for piece, n in _bounded(nodes[cut == part], sizes[cut == part], most):
            which = np.repeat(np.arange(n.size), n)
            nth = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)
            wide = (piece[:, 3] - piece[:, 2])[which]
            x, y = piece[which, 0] + nth // wide, piece[which, 2] + nth % wide
            keep = x < y
            yield x[keep], y[keep]


def _early_pairs(nodes: np.ndarray, prefixes: np.ndarray, search: Search, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of the leaf node pairs whose prefixes differ in no more bits than the walk allows, some ``most`` pairs at a time."""
    for a0, a1, b0, b1 in nodes:
        step = max(1, most // int(b1 - b0))
        for lo in range(a0, a1, step):
            hi = min(a1, lo + step)
            places = np.flatnonzero(np.bitwise_count(prefixes[lo:hi, None] ^ prefixes[None, b0:b1]) <= search.early)
            x, y = lo + places // (b1 - b0), b0 + places % (b1 - b0)
            keep = x < y
            yield x[keep], y[keep]


def _bounded(nodes: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A node pair of more than ``most`` pairs is cut into strips of its first node."""
    small = sizes <= most
    if small.any():
        yield nodes[small], sizes[small]
    for a0, a1, b0, b1 in nodes[~small]:
        step = max(1, most // int(b1 - b0))
        for lo in range(a0, a1, step):
            hi = min(a1, lo + step)
            yield np.array([[lo, hi, b0, b1]]), np.array([(hi - lo) * (b1 - b0)])


def linked(prints: DataFrame, how: Fingerprints, search: Search) -> DataFrame:
    """Links (a, b) between fingerprints that connect all pairs the search finds.

    ``prints`` holds distinct fingerprints in a binary column ``fp``. Rows are dealt by trie and its first bits, where
    partners agree. A node with more than a task should hold is replaced by the pairs of its descendants, so that no key
    gathers an unbounded group. A task puts out a spanning forest of what it found, never all pairs of a group.
    """
    total = prints.count()
    shared = min(at_least(total, _WANTED), how.bits // search.tries) if search.first is None else search.first
    starts = [t * how.bits // search.tries for t in range(search.tries)]
    rows = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), _bits(F.col("fp"), s, 64, how.bits).alias("key")) for t, s in enumerate(starts)])).alias("x"),
    ).select("fp", "x.trie", "x.key")
    shift = 64 - shared
    node = F.shiftrightunsigned("key", shift) if shared else F.lit(0).cast("bigint")
    rows = rows.select(
        "fp", "trie", "key", node.alias("u"), node.alias("v"), F.lit(shared).alias("level"), F.lit(0).alias("diff"), F.lit(0).alias("side")
    )
    rows = _descend(rows, search, _MOST)
    pair = ["trie", "u", "v", "level", "diff"]
    width = how.bits // 8

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_pylist()
        values = np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, width // 8)
        side = table.column("side").to_numpy()
        t, level, diff = (table.column(c)[0].as_py() for c in ("trie", "level", "diff"))
        labels = join_tries(values, side, starts[t], level, diff, search)
        moved = np.flatnonzero(labels != np.arange(labels.size))
        return pa.table({"a": pa.array([fps[i] for i in moved], pa.binary()), "b": pa.array([fps[i] for i in labels[moved]], pa.binary())})

    return rows.select("fp", "side", *pair).groupBy(*pair).applyInArrow(run, "a binary, b binary")


def _bits(fp: Column, start: int, n: int, total: int) -> Column:
    """``n`` <= 64 bits of a binary fingerprint from bit ``start`` on, wrapping round, as a bigint."""
    byte, shift = divmod(start % total, 8)
    twice = F.concat(fp, fp)
    high = F.conv(F.hex(F.substring(twice, byte + 1, 8)), 16, -10).cast("bigint")
    if not shift:
        return high
    low = F.conv(F.hex(F.substring(twice, byte + 9, 1)), 16, 10).cast("bigint")
    return F.shiftleft(high, shift).bitwiseOR(F.shiftrightunsigned(low, 8 - shift))


def _descend(rows: DataFrame, search: Search, most: int, bits: int = 4) -> DataFrame:
    """Replaces node pairs of over ``most`` fingerprints by the pairs of their descendants ``bits`` levels below.

    A descendant pair keeps both nodes and the differences walked so far; over budget it is not made. Nodes paired with
    themselves make each unordered pair once.
    """
    pair = ["trie", "u", "v", "level", "diff"]
    while True:
        sizes = rows.groupBy(*pair).count()
        large = stage(sizes.where((F.col("count") > most) & (F.col("level") + bits <= search.depth)).select(*pair), "large")
        if large.isEmpty():
            return rows
        rows = stage(rows, "tries")
        marked = rows.join(large.withColumn("_large", F.lit(True)), pair, "left")
        kept = marked.where("_large is null").drop("_large")
        mine = F.expr(f"shiftrightunsigned(key, 64 - level - {bits}) & {(1 << bits) - 1}").cast("int")
        split = marked.where("_large").drop("_large").withColumn("_mine", mine)
        other = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))
        both = split.select("*", other.alias("_other")).withColumn("_more", F.bit_count(F.col("_mine").bitwiseXOR(F.col("_other"))))
        both = both.where(F.col("diff") + F.col("_more") <= search.early)
        own = F.col("u") == F.col("v")
        low = F.least("_mine", "_other")
        high = F.greatest("_mine", "_other")
        first = F.when(own, low).when(F.col("side") == 0, F.col("_mine")).otherwise(F.col("_other"))
        second = F.when(own, high).when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_mine"))
        side = F.when(own, (F.col("_mine") > F.col("_other")).cast("int")).otherwise(F.col("side"))
        split = both.select(
            "fp",
            "trie",
            "key",
            (F.shiftleft("u", bits).bitwiseOR(first.cast("bigint"))).alias("u"),
            (F.shiftleft("v", bits).bitwiseOR(second.cast("bigint"))).alias("v"),
            (F.col("level") + bits).alias("level"),
            (F.col("diff") + F.col("_more")).cast("int").alias("diff"),
            side.alias("side"),
        )
        rows = stage(kept.unionByName(split), "tries")


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", how: Fingerprints = Fingerprints(), search: Search = EXACT
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (hex text) and ``component_id``.

    ``component_id`` is the least id of all rows that can be reached over links, the row itself included. Ids keep their
    name; other columns are not read. Repeated rows and equal texts share a fingerprint and so a component. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null id get the least id of their
    component, or null if it has none. An empty table gives an empty result.
    """
    prints = stage(with_fingerprints(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", how, "fp"), "prints")
    owners = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "owners")
    roots = components(linked(owners.select("fp"), how, search))
    rooted = owners.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Stored, so that the join has a plain shuffle on both sides and a component of very many fingerprints can be split.
    rooted = stage(rooted, "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_print = stage(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_column), F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


def sets_of(data: list[bytes], how: Similar) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, text after text, and how many each text has."""
    hashed, counts = shingles_of(data, how.shingle, how.seed)
    owner = np.repeat(np.arange(counts.size), counts)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(hashed.size, bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.bincount(owner[new], minlength=counts.size)


def band_keys(hashed: np.ndarray, counts: np.ndarray, how: Similar) -> np.ndarray:
    """A key per text and band; every text has shingles. Equal sets have equal keys."""
    out = np.zeros((counts.size, how.bands), np.uint64)
    begin = np.cumsum(counts) - counts
    factors = np.random.default_rng(how.seed).integers(0, 1 << 63, (how.bands, how.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(how.bands):
        for factor in factors[b]:
            out[:, b] = mix(out[:, b] ^ np.minimum.reduceat(hashed * factor, begin))
    return out


def _sketches(docs: DataFrame, how: Similar) -> DataFrame:
    """(row, id, sig, n, fp) of (row, id, text): ``sig`` is 128 bits of the set of shingles, ``n`` its size, ``fp`` its SimHash."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            hashed, counts = sets_of(encoded(batch.column(2).to_pylist()), how)
            ends = np.cumsum(counts)
            sigs = [xxhash.xxh3_128_digest(hashed[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            columns = [pa.array(sigs, pa.binary()), pa.array(counts, pa.int64()), as_binary(majorities(hashed, counts, how.bits))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "id", "sig", "n", "fp"])

    return docs.select("row", "id", "text").mapInArrow(run, f"row bigint, id {kind}, sig binary, n bigint, fp binary")


def parity_bits(hashed: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """For each set the parity of its elements by their last bits, in 4 to 8 bits an element, at least 64.

    Two sets differ in at least as many elements as their parities differ in bits. Lengths are powers of two; the xor of the
    halves is the parity of half the length.
    """
    length = 1 << np.ceil(np.log2(np.maximum(64, 4 * counts))).astype(np.int64)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(counts.size), counts)
    at = (ends - length)[owner] + (hashed & (length - 1).astype(np.uint64)[owner]).astype(np.int64)
    places, times = np.unique(at, return_counts=True)
    bits = np.zeros(int(length.sum()), np.uint8)
    bits[places[times % 2 == 1]] = 1
    packed = np.packbits(bits, bitorder="little")
    return [packed[i:j].tobytes() for i, j in zip(((ends - length) // 8).tolist(), (ends // 8).tolist())]


def _whole_sets(docs: DataFrame, members: DataFrame, how: Similar) -> DataFrame:
    """(key, i, row, n, s, p) of the members: size and elements of a text's set and its parities, as bytes."""
    names = ["key", "i", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            hashed, counts = sets_of(encoded(batch.column(3).to_pylist()), how)
            ends = np.cumsum(counts)
            sets = [hashed[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]
            columns = [pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, parity_bits(hashed, counts)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [*names, "n", "s", "p"])

    wanted = docs.select("row", "text").where(may_be_in(members.select("row"), F.col("row")))
    wanted = wanted.join(members.select(*names), "row").select(*names, "text")
    return wanted.mapInArrow(run, "key bigint, i int, row bigint, n bigint, s binary, p binary")


def common_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int = 2048) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``; both are (elements set after set, sizes).

    Products of 0/1 matrices, ``width`` elements at a time and only elements that occur on both sides.
    """
    shared = np.intersect1d(a[0], b[0])
    out = np.zeros((a[1].size, b[1].size), np.float64)
    sides = []
    for elements, sizes in (a, b):
        at = np.searchsorted(shared, elements)
        known = at < shared.size
        known[known] = shared[at[known]] == elements[known]
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], np.repeat(np.arange(sizes.size), sizes)[known][order], sizes.size))
    for low in range(0, shared.size, width):
        parts = []
        for at, owner, n in sides:
            begin, end = np.searchsorted(at, (low, low + width))
            part = np.zeros((n, min(width, shared.size - low)), np.float32)
            part[owner[begin:end], at[begin:end] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def asked_pairs(side: np.ndarray, root: np.ndarray, sizes: np.ndarray, how: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places x, y and which pairs of them a task compares: side 0 with side 1, or side 0 with itself.

    Pairs of one root are connected already, and sizes too far apart cannot be near.
    """
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not y.size
    y = x if own else y
    asked = root[x][:, None] != root[y][None, :]
    if own:
        asked &= x[:, None] < y[None, :]
    low, high = np.minimum(sizes[x][:, None], sizes[y][None, :]), np.maximum(sizes[x][:, None], sizes[y][None, :])
    return _used(x, y, asked & (10 * low >= how.share * high))


def _used(x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the places that are in no pair."""
    rows, columns = asked.any(axis=1), asked.any(axis=0)
    return x[rows], y[columns], asked[np.ix_(rows, columns)]


def may_be_near(x: np.ndarray, y: np.ndarray, asked: np.ndarray, sizes: np.ndarray, parities: list[bytes], how: Similar) -> np.ndarray:
    """Which of the asked pairs the parities leave open; a near pair is always among them."""
    out = np.zeros(asked.shape, bool)
    length = np.fromiter((len(p) for p in parities), np.int64, len(parities))
    for lx in np.unique(length[x]):
        for ly in np.unique(length[y]):
            i, j = np.flatnonzero(length[x] == lx), np.flatnonzero(length[y] == ly)
            if not asked[np.ix_(i, j)].any():
                continue
            left, right = (_folded([parities[n] for n in z], min(lx, ly)) for z in (x[i], y[j]))
            for n, one in zip(i, left):
                apart = np.bitwise_count(right ^ one).sum(axis=1, dtype=np.int64)
                out[n, j] = (10 + how.share) * apart <= (10 - how.share) * (sizes[x[n]] + sizes[y[j]])
    return out & asked


def _folded(parities: list[bytes], size: int) -> np.ndarray:
    """Parities of equal length as rows of 64-bit words, folded to ``size`` bytes."""
    words = np.frombuffer(b"".join(parities), np.uint64).reshape(len(parities), -1)
    while words.shape[1] * 8 > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def near_within(
    side: np.ndarray, root: np.ndarray, sets: list[bytes], parities: list[bytes], how: Similar
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest, as places (a, b), of the near pairs that a task compares, and how many near partners each place has."""
    sizes, partners = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets)), np.zeros(len(sets), np.int64)
    x, y, asked = asked_pairs(side, root, sizes, how)
    x, y, asked = _used(x, y, may_be_near(x, y, asked, sizes, parities, how))
    if not x.size:
        return x, y, partners
    a, b = ((np.frombuffer(b"".join([sets[i] for i in z]), np.uint64), sizes[z]) for z in (x, y))
    common = common_counts(a, b)
    near = asked & (10 * common >= how.share * (a[1][:, None] + b[1][None, :] - common))
    partners[x] += near.sum(axis=1)
    partners[y] += near.sum(axis=0)
    i, j = np.nonzero(near)
    labels = merge(np.arange(len(sets)), x[i], y[j])
    moved = np.flatnonzero(labels != np.arange(labels.size))
    return moved, labels[moved], partners


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[int], pa.Table]]:
    """Consecutive rows of equal keys, which may cross batches."""
    held: list[pa.RecordBatch] = []
    last: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(bounds[:-1], bounds[1:]):
            key = keys[begin].tolist()
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


_TASK = ["key", "i", "j"]


def _promising(deals: DataFrame, sets: DataFrame, how: Similar) -> DataFrame:
    """The deals whose row has a partner in its task that sizes and parities leave open; no near pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _by_key(batches, _TASK):
            side, root, n = (table.column(c).to_numpy() for c in ("side", "root", "n"))
            x, y, asked = asked_pairs(side, root, n, how)
            x, y, _ = _used(x, y, may_be_near(x, y, asked, n, table.column("p").to_pylist(), how))
            if x.size:
                yield from table.select([*_TASK, "side", "row", "root"]).take(pa.array(np.union1d(x, y))).to_batches()

    dealt = deals.join(sets.select("row", "n", "p"), "row").repartition(*_TASK).sortWithinPartitions(*_TASK)
    return dealt.select(*_TASK, "side", "row", "root", "n", "p").mapInArrow(run, deals.select(*_TASK, "side", "row", "root").schema)


def _verified(tasks: DataFrame, how: Similar) -> DataFrame:
    """Links (a, b) that connect the near pairs of every task (key, i, j) of (key, i, j, side, row, root, s, p).

    A set goes once to each task that its row is dealt to; a task compares inside and puts out a spanning forest. A link
    without ``b`` names the row with the most near partners in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _by_key(batches, _TASK):
            row, side, root = (table.column(c).to_numpy() for c in ("row", "side", "root"))
            a, b, partners = near_within(side, root, table.column("s").to_pylist(), table.column("p").to_pylist(), how)
            if a.size:
                links = [pa.array([*row[a].tolist(), int(row[partners.argmax()])], pa.int64()), pa.array([*row[b].tolist(), None], pa.int64())]
                whose = [pa.array([k] * (a.size + 1), kind) for k, kind in zip(key, (pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*links, *whose], ["a", "b", "key", "i"])

    dealt = tasks.repartition(*_TASK).sortWithinPartitions(*_TASK)
    return dealt.select(*_TASK, "side", "row", "root", "s", "p").mapInArrow(run, "a bigint, b bigint, key bigint, i int")


def _chunks(rows: Column, elements: Column) -> Column:
    """Chunks of a group so that one has about ``_ROWS`` rows and ``_ELEMENTS`` shingles; a longer text still is whole."""
    return F.greatest(F.ceil(rows / _ROWS), F.ceil(elements / _ELEMENTS)).cast("int")


def near_links(docs: DataFrame, sketches: DataFrame, how: Similar) -> DataFrame:
    """Links (a, b) between rows of (row, text) that connect all near pairs whose fingerprints the trie search connects.

    ``sketches`` holds a row of each distinct set. The tries join the fingerprints and put out forests, whose components are
    the candidates. Within a component all pairs of texts that links have not connected are compared by their whole sets, so
    no link stands on an estimate; parities rule most other pairs out for certain. A component is cut into chunks and a set
    goes once to the task of its chunk. Only components of several chunks go on: their rows meet the rows with the most near
    partners of some chunks, and then, where links have not connected all of them, pairs of chunks go to tasks; tasks see
    parities first, and only sets of rows with a pair left open are sent. No pair becomes a row.
    """
    spark, made = docs.sparkSession, []

    def kept(frame: DataFrame, purpose: str) -> DataFrame:
        stored, path = store(frame, purpose)
        made.append(path)
        return stored

    def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("row"), "root")
        return kept(rows.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")

    def compared(deals: DataFrame) -> DataFrame:
        open_ones = kept(_promising(kept(deals.select(*_TASK, "side", "row", "root"), "deals"), sets, how), "promising")
        return _verified(open_ones.join(sets.select("row", "s", "p"), "row"), how)

    prints = kept(sketches.groupBy("fp").agg(F.count("*").alias("m")), "prints")
    found = linked(prints.select("fp"), Fingerprints(how.shingle, how.bits, how.seed), how.search)
    roots = components(found).select(F.col("node").alias("fp"), "root")
    kin = prints.join(roots, "fp", "left").where("root is not null or m > 1")
    kin = kept(kin.select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("key")), "kin")
    members = kept(sketches.join(kin, "fp").select("key", "row", "n"), "members")
    sizes = kept(members.groupBy("key").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks")), "sizes")
    members = members.join(sizes, "key").select("key", "chunks", F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("i"), "row")
    members = kept(members, "members")
    sets = kept(_whole_sets(docs, members, how), "sets")
    own = sets.select("key", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "row", F.col("row").alias("root"), "s", "p")
    found = stage(_verified(own, how), "near")

    large = kept(members.where("chunks > 1"), "large")
    if not large.isEmpty():
        counted = sizes.where("chunks > 1")
        heads = found.where((F.col("i") < _HEADS) & F.col("b").isNull()).join(counted, "key").select("key", F.col("a").alias("row"), "chunks")
        rows = rooted(large, found)
        heads = heads.join(rows.select("row", "root"), "row").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(1).alias("side"), "row", "root")
        deals = rows.select("key", "i", F.lit(0).alias("side"), "row", "root").unionByName(heads).withColumn("j", F.lit(-1))
        found = stage(found.union(compared(deals)), "near")

        rows = rooted(large, found)
        mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        rows = rows.join(mixed.select("key"), "key").withColumnRenamed("i", "mine")
        deals = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("mine <> other")
        side = (F.col("mine") > F.col("other")).cast("int")
        deals = deals.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("side", side)
        found = stage(found.union(compared(deals)), "near")
    remove(spark, *made)
    return found.select("a", "b")


def first_of_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", how: Similar = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one row of each group of near duplicates: that of the least id.

    Groups are reached over any links between near texts. Rows are told apart by themselves, not by their id: of several
    rows with one id and near texts one is kept, rows with one id and other texts are other documents. Rows with a null
    id stay. Rows whose text has no words (null, empty, white space) hold nothing that could be near to another text and
    stay as well.
    """
    row = free_name(docs, "_row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    worded = docs.where(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]") & F.col(f"`{id_column}`").isNotNull()).select(
        F.col(row).alias("row"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")
    )
    sketches, sketched = store(_sketches(worded, how), "sketches")
    owners = stage(sketches.groupBy("sig").agg(F.min("row").alias("node")), "owners")
    single, once = store(sketches.join(owners.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", "fp"), "single")
    roots = components(near_links(worded, single, how)).select("node", "root")
    owners = stage(owners.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root")), "owners")
    rooted = stage(sketches.select("row", "id", "sig").join(owners, "sig").select("row", "id", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("m")).where("m > 1")
    least = stage(least.select("root", F.col("least.row").alias("first")), "least")
    lost = rooted.join(least, "root").where("row <> first").select(F.col("row").alias(row))
    lost = stage(lost, "lost")
    remove(docs.sparkSession, sketched, once)
    return without_rows(docs, lost, row).drop(row)
