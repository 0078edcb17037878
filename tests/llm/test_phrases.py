"""Weighted automata and phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import automata as A
from tidemark.llm import phrases as P


def plain_counts(texts, longest=3):
    """Counts of all phrases, as tuples of words in bytes."""
    out = Counter()
    for text in texts:
        lower = (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)))
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for i in range(len(words)):
                for n in range(1, longest + 1):
                    if i + n <= len(words):
                        out[tuple(words[i : i + n])] += 1
    return out


def plain(docs, how):
    rows = []
    by_lang = {}
    for lang, text in docs:
        by_lang.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by_lang.items():
        f = plain_counts(texts, how.longest)
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= how.least}
        out = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * c >= how.share * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in candidates.items()
            )
            if inside:
                continue
            score, k = min((how.factor * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            out.append((-score, -a, b" ".join(p).decode(), f[p[:k]], f[p[k:]], n))
        out.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        rows += [(lang, i + 1, r[2], -r[1], r[3], r[4], r[5], -r[0]) for i, r in enumerate(out[: how.limit])]
    return sorted(rows)


def some_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "A", "b", "bb", "été", "x\x01", "\x00", "d", "日本", "e" * 300] + ["a"] * 8
    docs = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ", "!"]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "fr", None, ""]), text))
    docs += [("en", None), ("en", ""), (None, " \t\n.,"), ("de", "A" * 9000), ("de", "a a " * 3000)]
    docs += [("en", "the same line here. and more")] * 30
    return docs


def as_map(a):
    words = a.words.to_pylist()
    return {
        tuple(words[w] for w in row): int(f)
        for n in range(1, len(a.levels) + 1)
        for row, f in zip(*(x.tolist() for x in A.phrases_of(a, n)))
    }


def counted(texts, longest=3, most=10**6):
    return [a for a in P.Tokens([(t or "").encode() for t in texts]).chunks(most, longest)]


@pytest.mark.parametrize("most", [10**6, 7, 1])
def test_counts_in_runs_of_any_length(most):
    texts = [t for _, t in some_docs(1, 30)][:40]
    want = plain_counts(texts, 4)
    assert as_map(A.united(counted(texts, 4, most))) == want


def test_stored_automata_are_minimal_and_whole():
    texts = ["a b c", "a b d", "x b c", "x b d", "q c", "q d"]
    a = counted(texts)[0]
    data = A.to_bytes(a)
    assert as_map(A.from_bytes(data)) == plain_counts(texts) == as_map(a)
    # Ways on behind (a b), (x b) and (q) are alike, as are those behind (a) and (x).
    head = np.frombuffer(data, "<i8", 6)
    signatures = set()

    def walk(prefix):
        arcs = tuple(sorted((p[-1], c, walk(p)) for p, c in plain_counts(texts).items() if p[:-1] == prefix))
        if arcs:
            signatures.add(arcs)
        return arcs

    walk(())
    assert head[4] == len(signatures)
    empty = A.Automaton(pa.array([], pa.large_binary()), [])
    assert as_map(A.from_bytes(A.to_bytes(empty))) == {}
    assert as_map(A.at_least(a, 10**6)) == {}


def test_ranges_part_every_automaton_alike():
    texts = [t for _, t in some_docs(2, 60)]
    a = A.united(counted(texts))
    words = a.words.to_pylist()
    bounds = tuple(sorted({b"a", b"a\0", b"b", b"b\0", b"d", words[-1]}))
    ranges = A.Ranges(bounds, ((bounds.index(b"a") + 1, 3), (bounds.index(b"b") + 1, 2)))
    parts = list(A.cut(a, ranges))
    where, total = {}, Counter()
    for key, part in parts:
        for phrase, f in as_map(part).items():
            assert where.setdefault(phrase, key) == key
            total[phrase] += f
    assert total == as_map(a) and len(set(where.values())) > 8
    assert len({k for p, k in where.items() if p[0] == b"a"}) > 4
    # Another automaton, without the longest phrases, is cut at the same places.
    some = A.Automaton(a.words, a.levels[:2])
    for key, part in A.cut(A.trimmed(some), ranges):
        assert all(where[p] == key for p in as_map(part))


def test_composition_and_lookup():
    texts = [t for _, t in some_docs(3, 50)]
    numbers = counted(texts)[0]
    f = plain_counts(texts)
    asked = counted(["a b a", "nowhere a", "a nowhere", "été"])[0]
    assert as_map(A.composed(asked, numbers)) == {p: f[p] for p in as_map(asked) if p in f}
    subs = as_map(P.sub_phrases(A.at_least(numbers, 5)))
    want = {}
    for p, c in f.items():
        if c >= 5:
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        want[p[i:j]] = max(want.get(p[i:j], 0), c)
    assert subs == want


@pytest.mark.parametrize("wanted", [1 << 21, 150])
@pytest.mark.parametrize("longest", [3, 4])
def test_collocations_like_plain_counting(spark, wanted, longest):
    docs = some_docs(wanted % 7)
    how = P.Settings(longest=longest, least=3, limit=40, wanted=wanted, chunk=64)
    frame = spark.createDataFrame([(i, t, l, 0, "x") for i, (l, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string")
    got = sorted(tuple(r) for r in P.collocations(frame.repartition(3), how=how).collect())
    assert got == plain(docs, how)


def test_large_counts_are_exact():
    words = pa.array([b"a", b"b"], pa.large_binary())
    big = 3 * 10**17
    parts = A.from_phrases(words, [(np.array([[0], [1]]), np.array([big + 1, big + 7]))])
    left, right, score = P.scored(np.array([[0, 1]]), np.array([big]), parts, 1_000_000)
    assert (left[0], right[0], score[0]) == (big + 1, big + 7, 1_000_000 * big * big // ((big + 1) * (big + 7)))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.collocations(empty).collect() == []
    assert P.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
