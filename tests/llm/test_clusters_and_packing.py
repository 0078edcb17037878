"""Centroid clustering and packing against plain loops."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import clusters as C
from tidemark.llm import packing as P
from tidemark.llm.queries import word_tokenizer

ODD_TEXTS = [
    None, "", " ", "\n\t ", "A", "Hello, World! it's we'll", "é ́x  é", "ß ΑΣ Σ", "x y z", "日本語 テスト",
    "<|startoftext|> a<|endoftext|>b", "a\x00b \x1c c", "🙂🙂 x", "1234 5.6", "  line", "'s 't's", "İstanbul K", "H̱a H̱. <|ENDOFTEXT|> <|endoftext|>. É. É, ÀÉ?! ×. ª. Ǆ", "a.b a..b. A1. (a) x.'s", "a" * 5000, "w " * 9000,
]


def plain_clusters(vectors, k, rounds, size):
    """(id, cluster, distance) and centroids by whole distances in every round."""
    kept = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in vectors
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(range(len(kept)), key=lambda n: (hashlib.sha256(f"3:{kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    centroids = [kept[n][1] for n in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assign())], centroids


@pytest.mark.parametrize("n", [3, 300])
def test_clusters_like_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(rng.integers(0, 4), 0.6, 6)], 7, "x") for i in range(n)]
    rows += [(1, rows[0][1], 0, "y"), (1, [9.0] * 6, 0, "y")]  # an id twice, a vector twice
    rows += [(-4, None, 0, ""), (-5, [1.0] * 5, 0, ""), (-6, [1.0] * 5 + [None], 0, ""), (-7, [math.inf] * 6, 0, ""), (-8, [math.nan] * 6, 0, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    how = C.Settings(k=4, rounds=5, size=6, block=50)
    got = C.clustered(frame, how=how).collect()
    want, centroids = plain_clusters([r[:2] for r in rows], 4, 5, 6)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    inertia = {j: sum(d for _, c, d in want if c == j) for j in range(4)}
    for r in got:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert C.clustered(empty).collect() == []
    assert C.clustered(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        C.clustered(huge).collect()


def test_products_follow_only_what_changed():
    rng = np.random.default_rng(5)
    rows, before, after = rng.integers(-900, 900, (40, 8)), rng.integers(-900, 900, (3, 8)), None
    after = before.copy()
    after[0, 2], after[2, 5:] = 17, 3
    products = rows @ before.T
    rows_seen = rows.copy()
    rows_seen[:, [0, 1, 3, 4]] = 10**9  # components that no centroid changed are never read
    assert (C.moved(products, rows_seen, after - before) == rows @ after.T).all()


@pytest.mark.parametrize("remembered", [1 << 19, 60])
def test_unit_ids_equal_the_library(monkeypatch, remembered):
    path = word_tokenizer()
    whole = Tokenizer.from_file(path)
    random.seed(3)
    monkeypatch.setattr(P, "_REMEMBERED", remembered)
    letters = "aAéÉH̱K²ª÷ \n\t.,'sß1́ 日🙂Σ<|>\x85\x0b\x1f"
    texts = ODD_TEXTS + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    encoder = P.UnitEncoder(open(path).read())
    for _ in range(2):  # the second time from memory
        for some in (texts[:10], texts[10:60], texts):
            flat, counts = encoder.encode([(t or "").encode() for t in some], 1)
            ends = np.cumsum(counts)
            for text, a, b in zip(some, ends - counts, ends):
                assert flat[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids + [1], text


def test_histogram_is_packed_whole_and_tight():
    rng = random.Random(8)
    for size, lengths in ((64, 64), (64, 5), (2048, 2048), (7, 1)):
        counts = {n: rng.randint(0, 400) for n in range(1, lengths + 1)}
        slots = P.pack_histogram(counts, size)
        fill, seen = {}, {}
        for s in slots:
            assert s.low == seen.get(s.length, 0)
            seen[s.length] = s.high
            packs, rest = divmod(s.high - s.low, s.times)
            assert not rest
            for p in range(s.sequence, s.sequence + packs):
                assert fill.get(p, 0) == s.offset
                fill[p] = s.offset + s.length * s.times
        assert seen == {n: c for n, c in counts.items() if c}
        assert sorted(fill) == list(range(len(fill))) and max(fill.values(), default=0) <= size
        total = sum(n * c for n, c in counts.items())
        assert len(fill) * size <= 1.05 * total + 3 * size
    # Copies in the billions cost nothing more.
    assert sum((s.high - s.low) for s in P.pack_histogram({2048: 10**12, 1000: 10**12, 24: 7}, 2048)) == 2 * 10**12 + 7


def test_pieces_cover_every_document(spark):
    random.seed(6)
    texts = ODD_TEXTS + ["same text here"] * 60 + [" ".join(random.choice("alpha be cc dog".split()) for _ in range(random.randint(1, 90))) for _ in range(80)]
    rows = [(i if i != 20 else None, t, "x", i) for i, t in enumerate(texts)] + [(30, "an id twice", "y", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(4)
    how = P.Settings(size=128)
    pieces = P.packed(frame, word_tokenizer(), how=how, ids=True)
    got = pieces.collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = []
    for i, text, _, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 128):
            data = struct.pack(f"<{len(ids[a:a + 128])}I", *ids[a : a + 128])
            want.append((str(i), a, len(ids[a : a + 128]), zlib.crc32(data), len(ids), data))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    for s in P.sequences(pieces, 128).collect():
        assert bytes(s.ids) == b"".join(x for _, _, x in sorted(by_sequence[s.sequence_id]))
        assert s.n_tokens * 4 == len(s.ids) and (s.padded_to == 128 or (s.padded_to == s.n_tokens and s.n_tokens.bit_count() == 1))


def test_no_documents(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []
