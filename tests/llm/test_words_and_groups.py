"""Word arrays, fingerprints, trie joins and components against plain loops."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components as C
from tidemark.llm import simhash as S
from tidemark.llm.frames import may_be_in
from tidemark.llm.words import LETTERS, SOLID, Words, encoded

random.seed(4)
ODD = [None, "", " ", "\t\n ", "A", "a b", "É é x", "a\u00a0b c", "x " * 400, "\x00 \x1f y", "日本 語"]


def some_texts(n):
    return ODD + [" ".join(random.choice("aa bb cc dd. Ee, ff|".split()) for _ in range(random.randint(0, 80))) for _ in range(n)]


def split(text, rule):
    data = (text or "").encode().lower()
    return bytes(c if rule[c] else 32 for c in data).split()


@pytest.mark.parametrize("rule", [LETTERS, SOLID])
def test_words(rule):
    texts = some_texts(40)
    words = Words(encoded(texts), rule)
    hashes, seen = words.hashes(), {}
    for text, first, n in zip(texts, words.first, words.counts):
        expected = split(text, rule)
        got = [bytes(words.buffer[words.start[i] : words.end[i]]) for i in range(first, first + n)]
        assert got == expected
        for word, h in zip(got, hashes[first : first + n].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def plain_print(text, k=3):
    words = split(text, SOLID)
    hashed = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_fingerprints():
    texts = some_texts(40)
    assert S.fingerprints_of(encoded(texts), S.Fingerprints())[:, 0].tolist() == [plain_print(t) for t in texts]


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 1 << 63, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 7)):
            x = base
            for _ in range(rng.integers(0, 4)):
                x ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def linked_sets(values, budget=2):
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget)
    return S.merge(np.arange(values.size), a, b)


def test_trie_join_of_one_node():
    values = clustered(150)
    assert (S.join_tries(values[:, None], np.zeros(values.size, int), 0, 0, 0, S.EXACT) == linked_sets(values)).all()


def as_rows(spark, values):
    return spark.createDataFrame([(bytearray(int(v).to_bytes(8, "big")),) for v in values], "fp binary")


@pytest.mark.parametrize("most", [60_000, 20])
def test_links_over_partitions(spark, monkeypatch, most):
    """Also with nodes so small that they are split over several tasks."""
    monkeypatch.setattr(S, "_MOST", most)
    monkeypatch.setattr(S, "_WANTED", 40)
    values = clustered(60, seed=2)
    links = S.linked(as_rows(spark, values), S.Fingerprints(), S.EXACT).collect()
    at = {int(v).to_bytes(8, "big"): i for i, v in enumerate(values)}
    a, b = (np.array([at[bytes(r[i])] for r in links]) for i in (0, 1))
    assert (S.merge(np.arange(values.size), a, b) == linked_sets(values)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    rows = [*chain, (100, 101), (7, 7), (None, 3), (200, 100), (55, 54)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100, 54: 54, 55: 54}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base.upper()), (4, "other words stand here"), (1, None), (2, ""), (4, "other words stand here"), (None, "alone again")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.simhash_groups(frame).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (4, 4), (1, 1), (2, 1), (None, None)], key=str)
    assert S.simhash_groups(frame.limit(0)).count() == 0


def test_one_of_near_copies_stays(spark):
    rng = random.Random(6)
    pages = [" ".join(f"{rng.randrange(10**6)}" for _ in range(400)) for _ in range(12)]
    rows = [(i, p) for i, p in enumerate(pages)]
    for i, p in enumerate(pages[:6]):
        words = p.split()
        for at in (50, 200, 350)[: 1 + i % 3]:
            words[at] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (None, pages[0]), (7, pages[7])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _lost int, _again int")
    kept = S.first_of_groups(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(12), 300, 301, None], key=str)


def shingle_set(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def similarity(x, y):
    x, y = shingle_set(x), shingle_set(y)
    return len(x & y) / len(x | y)


def plain_firsts(rows, share=0.8):
    """The least (id, place) of each set of rows connected by pairs of at least this similarity."""
    label = list(range(len(rows)))
    for i, (_, x) in enumerate(rows):
        for j in range(i):
            if similarity(x, rows[j][1]) >= share:
                old, new = label[i], label[j]
                label = [new if n == old else n for n in label]
    return sorted(min((rows[i][0], i) for i in range(len(rows)) if label[i] == n)[1] for n in set(label))


def rewritten(rng, words, at):
    words = list(words)
    for i in at:
        words[i] = f"n{rng.randrange(10**9)}"
    return words


def test_near_copies_against_all_pairs(spark):
    """Pairs just above and below 0.8, chains, a family of copies beside another that shares passages, equal ids."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for i in range(40):
        base = fresh(204)
        texts += [base, rewritten(rng, base, range(10, 10 + 7 * (3 + i % 4), 7))]
    shared = fresh(150)
    for own in (fresh(100), fresh(100)):
        texts += [shared + rewritten(rng, own, [rng.randrange(100)]) for _ in range(12)]
    line = fresh(12)
    texts += [fresh(146) + line * 30 for _ in range(6)]
    chain = fresh(200)
    for i in range(5):
        texts.append(chain)
        chain = chain[15:] + fresh(15)
    rng.shuffle(texts)
    rows = [(i % 100, " ".join(t)) for i, t in enumerate(texts)]
    got = S.first_of_groups(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int"))
    assert sorted(r["place"] for r in got.collect()) == plain_firsts(rows)


def test_common_counts_like_sets():
    rng = np.random.default_rng(4)
    sides = []
    for n in (7, 11):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)]
        sides.append((np.concatenate(sets), np.array([s.size for s in sets]), [set(s.tolist()) for s in sets]))
    for width in (1, 7, 2048):
        got = S.common_counts(sides[0][:2], sides[1][:2], width)
        assert got.tolist() == [[len(x & y) for y in sides[1][2]] for x in sides[0][2]]


def test_parities_leave_every_near_pair_open():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 20, 126, 130, 900):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for own in (0, n // 20, n // 9, n // 8, n // 5, n):
            sets.append(np.unique(np.concatenate((base[own:], rng.integers(0, 1 << 63, own, np.uint64)))))
    sizes = np.array([x.size for x in sets])
    parities, every = S.parity_bits(np.concatenate(sets), sizes), np.arange(sizes.size)
    alike = 10 * np.minimum.outer(sizes, sizes) >= 8 * np.maximum.outer(sizes, sizes)
    still = S.may_be_near(every, every, alike, sizes, parities, S.SIMILAR)
    plain = [set(x.tolist()) for x in sets]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in plain] for a in plain])
    # Every near pair stays open, and most others of like size do not.
    assert still[near].all() and near.sum() > 50
    assert 5 * (still & ~near).sum() < (alike & ~near).sum()


def test_chunks_of_a_band_lose_no_link(spark, monkeypatch):
    """A family of texts of which only some pairs are near, its bands cut into chunks of five rows."""
    monkeypatch.setattr(S, "_ROWS", 5)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(240)]
    rows = [(i, " ".join(rewritten(rng, base, rng.sample(range(240), rng.choice((2, 4, 6, 8)))))) for i in range(60)]
    rows += [(100, " ".join(base)), (3, " ".join(base))]
    got = S.first_of_groups(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int"))
    want = plain_firsts(rows)
    assert 1 < len(want) < 60 and sorted(r["place"] for r in got.collect()) == want


def test_rows_that_share_a_repeated_line_stay(spark):
    """146 own shingles and a line of 12 words 30 times: a similarity of 0.04."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line = fresh(12)
    rows = [(i, " ".join(fresh(146) + line * 30)) for i in range(8)]
    assert S.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == 8


def test_one_id_with_two_texts(spark):
    """Id 5 has a copy of id 1 and a copy of id 7; one row of each text stays."""
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    frame = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(map(tuple, S.first_of_groups(frame).collect())) == [(1, a), (5, b)]


def test_recall_does_not_hang_on_the_number_of_texts():
    """Sets at a similarity of 0.8 share a band as often as the stated law says; nothing in it knows how many texts there are."""
    rng = np.random.default_rng(9)
    pairs = 3000
    common, own = rng.integers(0, 1 << 63, (pairs, 160), np.uint64), rng.integers(0, 1 << 63, (2, pairs, 20), np.uint64)
    keys = [S.band_keys(np.hstack((common, o)).ravel(), np.full(pairs, 180), S.SIMILAR) for o in own]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.998
    assert (keys[0] == keys[1]).mean() == pytest.approx(0.8**5, abs=0.02)


def test_tries_link_sets_at_the_stated_share():
    """Of pairs of sets at a similarity of 0.8 the tries of the near-duplicate search meet as many as the law says."""
    rng = np.random.default_rng(10)
    pairs, search = 1500, S.SIMILAR.search
    common, own = rng.integers(0, 1 << 63, (pairs, 160), np.uint64), rng.integers(0, 1 << 63, (2, pairs, 20), np.uint64)
    prints = [S.majorities(np.hstack((common, o)).ravel(), np.full(pairs, 180), S.SIMILAR.bits) for o in own]
    apart = S.differing(np.vstack(prints), np.arange(pairs), np.arange(pairs) + pairs)
    assert apart.mean() / S.SIMILAR.bits == pytest.approx(np.arccos(160 / 180) / np.pi, abs=0.01)
    met = np.zeros(pairs, bool)
    for t in range(search.tries):
        x, y = (S.trie_keys(p, t * S.SIMILAR.bits // search.tries) >> np.uint64(64 - search.depth) for p in prints)
        met |= (x >> np.uint64(search.depth - search.first) == y >> np.uint64(search.depth - search.first)) & (np.bitwise_count(x ^ y) <= search.early)
    assert (met & (apart <= search.budget)).mean() >= 0.999


@pytest.mark.parametrize("leaf", [33, 1 << 16])
def test_wide_tries_like_all_pairs(leaf):
    """Long fingerprints with few early differences, whether node pairs are walked far or compared at once."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (40, 4), np.uint64)
    values = np.repeat(base, 8, axis=0)
    values ^= rng.integers(0, 1 << 63, values.shape, np.uint64) & rng.integers(0, 1 << 63, values.shape, np.uint64) & rng.integers(0, 1 << 63, values.shape, np.uint64)
    search = S.Search(budget=60, tries=1, early=5, depth=24, first=0, leaf=leaf)
    got = S.join_tries(values, np.zeros(len(values), int), 16, 0, 0, search)
    keys = S.trie_keys(values, 16) >> np.uint64(40)
    a, b = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 5)
    want = linked_sets_wide(values, a, b, 60)
    # Neighbours in key order are linked whatever their early bits, so sets may be larger, never smaller.
    assert all(len(set(got[want == w])) == 1 for w in set(want))
    every = np.arange(len(values))
    assert all(got[i] == got[j] for i, j in zip(every, want))
    assert len(set(got)) > 20


def linked_sets_wide(values, a, b, budget):
    near = S.differing(values, a, b) <= budget
    return S.merge(np.arange(len(values)), a[near], b[near])


def test_near_copies_come_through_the_tries(spark, monkeypatch):
    """Without links of the trie search no two different texts are compared."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "new", *words[101:]])), (3, " ".join(words))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in S.first_of_groups(frame).collect()] == [1]
    searches, found = [], S.linked

    def none(prints, how, search):
        searches.append((prints.count(), how.bits, search))
        return found(prints, how, search).limit(0)

    monkeypatch.setattr(S, "linked", none)
    assert sorted(r["doc_id"] for r in S.first_of_groups(frame).collect()) == [1, 2]
    assert searches == [(2, S.SIMILAR.bits, S.SIMILAR.search)]


def test_filter_passes_every_id(spark):
    """The filter lets no listed id go and clears most others, so an exact join behind it gets few rows."""
    ids = spark.range(0, 30_000, 3)
    got = spark.range(60_000).withColumn("may", may_be_in(ids, F.col("id"))).toPandas()
    listed = (got["id"] < 30_000) & (got["id"] % 3 == 0)
    assert got["may"][listed].all() and got["may"][~listed].mean() < 0.01
    assert not spark.range(5).withColumn("may", may_be_in(ids.limit(0), F.col("id"))).where("may").count()
