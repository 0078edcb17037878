"""Benchmark passages, quality, likelihood and pieces against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import hmm, pieces, quality, winnow
from tidemark.llm.queries import piece_model

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        listed = sorted(str(i) for i in found)
        yield doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d."]) for _ in range(n))
    items = [(1, text(30)), (2, text(10)), (3, text(7)), (4, "one"), (5, None), (6, "..."), (2, text(12))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100, f"{text(20)} {items[0][1][8:]} {items[1][1]} {text(9)}"), (101, items[0][1]), (102, None), (None, items[3][1]), (101, items[0][1]), (103, "x" * 50_000)]
    frames = [spark.createDataFrame([(*r, 7) for r in rows], f"{name} long, text string, row int") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = sorted(map(tuple, winnow.contamination(*frames).collect()), key=str)
    assert got == sorted(plain_contamination(docs, items), key=str)
    kept = winnow.without_passages(*frames)
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in plain_contamination(docs, items) if not r[5]), key=str)
    assert winnow.contamination(frames[0].limit(0), frames[1]).count() == 0
    assert not winnow.contamination(frames[0], frames[1].limit(0)).where("contaminated").count()


def test_winnowing_finds_every_shared_window():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)
    kept = set(winnow._winnow(hashes, np.array([0]), np.array([400]), 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(395))
    again = set((winnow._winnow(hashes[100:200], np.array([0]), np.array([100]), 6) + 100).tolist())
    assert again <= kept


def test_attention_gradients():
    how = quality.Settings(hidden=3, attention=2)
    rng = np.random.default_rng(0)
    x, n, y = rng.normal(size=(7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.fit([x[:3], x[3:4], x[4:]], y, quality.Settings(hidden=3, attention=2, epochs=1))
    loss = lambda: -np.mean(y * np.log(quality.forward(model, x, n)["s"]) + (1 - y) * np.log(1 - quality.forward(model, x, n)["s"]))
    grads = quality._gradients(model, x, n, y)
    for name in "VUwcb":
        at = (0,) * model.p[name].ndim
        kept, step = model.p[name][at], 1e-6
        model.p[name][at] = kept + step
        high = loss()
        model.p[name][at] = kept - step
        low = loss()
        model.p[name][at] = kept
        assert grads[name][at] == pytest.approx((high - low) / (2 * step), abs=1e-6)
    alpha = quality.forward(model, x, n)["alpha"]
    assert np.add.reduceat(alpha, [0, 3, 4]) == pytest.approx([1, 1, 1])
    assert how.hidden == 3


def test_quality_of_whole_texts(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("the of and word there".split()) for _ in range(120))
    rows = [(i, good() if i % 2 else good().replace(" ", "### ").upper()) for i in range(160)]
    rows += [(900, None), (901, ""), (None, good()), (1, good())]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(900, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 160]
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in held} == {2}
    assert all(r["predicted"] == r["doc_id"] % 2 for r in held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 160 and doc_id % 2 = 0").count() == 0
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1.0}


def test_passages_cover_whole_texts():
    how = quality.Settings(words=4, most=3)
    texts = [b"", b"a b c", b" ".join(b"w%d" % i for i in range(50)), b"\n x"]
    x, n = quality.passages(texts, how)
    assert n.tolist() == [1, 1, 3, 1] and x.shape == (6, quality.WIDTH) and np.isfinite(x).all()


def brute_forward(model, sequence):
    total = 0.0
    for path in itertools.product(range(model.start.size), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[path[0], sequence[0]]
        for a, b, s in zip(path, path[1:], sequence[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    return math.log10(total)


def small_model(k=3, c=5):
    rng = np.random.default_rng(2)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))))


def test_forward_is_exact():
    model = small_model()
    sequences = [np.array(s, np.int16) for s in ([0], [1, 2, 3], [4, 4, 0, 1, 2, 3], [2, 2])]
    assert hmm.forward_log10(model, sequences) == pytest.approx([brute_forward(model, s) for s in sequences])


def test_rounds_raise_the_likelihood():
    how = hmm.Settings(states=3, classes=5, segment=64)
    rng = np.random.default_rng(5)
    sequences = [np.array([(i // 3 + rng.integers(2)) % 4 for i in range(40)] + [4], np.int16) for _ in range(30)]
    raw, model = [s.tobytes() for s in sequences], small_model()
    seen = []
    for _ in range(6):
        seen.append(hmm.forward_log10(model, sequences).sum())
        model = hmm.improved(hmm._summed(model, raw, how), np.full(5, 0.001))
    assert all(b > a - 1e-6 for a, b in zip(seen[1:], seen[2:])) and seen[-1] > seen[0]
    assert hmm._summed(model, raw, how)[2].sum() == pytest.approx(sum(s.size for s in sequences), rel=1e-5)


def test_every_round_learns_from_all_rows(spark):
    """Also where a third of 4,500 texts are copies of one: the model is that of plain rounds over all of them."""
    how = hmm.Settings(states=2, classes=6, rounds=3)
    rng = np.random.default_rng(7)
    same = np.array([0, 1, 0, 1, 5], np.int16).tobytes()
    raw = [same if i % 3 == 0 else np.append(rng.integers(0, 5, 6), 5).astype(np.int16).tobytes() for i in range(4500)]
    prior = np.full(6, 1 / 6)
    want = hmm._first_model(prior, how)
    for _ in range(how.rounds):
        want = hmm.improved(hmm._summed(want, raw, how), prior)
    got = hmm.train(spark.createDataFrame([(bytearray(r),) for r in raw], "classes binary"), prior, how)
    assert got.emit == pytest.approx(want.emit, rel=1e-3) and got.move == pytest.approx(want.move, rel=1e-3)


def test_text_scores(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("The of a word1 x\u00e9 longerword".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, "never seen words"), (None, "the of"), (3, "again"), (102, "w" * 20_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int")
    counts = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((i, len(tokens), sum(x in counts for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    # A bound of three known words sends all others through the join.
    for known in (1 << 18, 3):
        got = hmm.text_scores(frame, hmm.Settings(known=known)).collect()
        assert all(r["score"] < 0 for r in got)
        rounded = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
        assert sorted(rounded, key=str) == sorted(want, key=str)
    assert hmm.text_scores(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        return sentencepiece.SentencePieceProcessor(model_file=piece_model())
    except Exception:
        pytest.skip("no piece model")


ODD = ["", " ", "  ", "a  b", "\t a\n", "\x00", "<s>", "日本", "▁x", " ▁", "a\u3000b", "x" * 3000, " " * 90 + "y" * 70, "<0x41>", "😀𐍈 ok", "ab" * 90]


def test_pieces_equal_the_library(library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdeth   \n.éß日😀0129▁ingerr") for _ in range(rng.randint(0, 150))) for _ in range(500)]
    vocabulary = pieces.load_vocabulary(piece_model())
    decoder = pieces.Decoder(vocabulary)
    for text, ids in zip(texts, pieces.Encoder(vocabulary).encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoder.decode(ids) == library.decode(want)


def test_piece_frames(spark, library):
    rows = [(1, "some text"), (2, None), (None, ""), (1, "some text"), (3, "z" * 30_000)]
    frame = spark.createDataFrame([(*r, "kept", "gone") for r in rows], "doc_id long, text string, decoded string, ids string")
    coded = pieces.encode_pieces(frame, piece_model())
    assert coded.columns == ["doc_id", "text", "decoded", "ids"] and coded.first()["decoded"] == "kept"
    back = pieces.decode_pieces(coded, piece_model(), name="back").collect()
    assert [r["back"] for r in back] == [r["text"] or "" for r in back]
    digest = {r["doc_id"]: r for r in pieces.token_digest(frame, piece_model()).collect()}
    ids = library.encode("some text", add_bos=True, add_eos=True)
    assert digest[1]["n_tokens"] == len(ids)
    assert digest[1]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert pieces.token_digest(frame.limit(0), piece_model()).count() == 0
