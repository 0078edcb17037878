"""Text likelihood under a hidden Markov model of word classes, with a unigram model of the same counts beside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import pieces, reach_workers, stage
from tidemark.llm.words import SOLID, Words, encoded, mix


@dataclass(frozen=True)
class Settings:
    """``states`` hidden states emit one of ``classes`` word classes; the last class is the end of a text.

    A word's class follows from its bytes: short words by their whole, longer ones by their last three bytes. Training
    starts from the shares of the classes among all training tokens and makes ``rounds`` Baum-Welch rounds over all of
    them, in segments of ``segment`` tokens. ``known`` is the most words whose counts go to every task; counts of all
    others are joined.
    """

    states: int = 8
    classes: int = 2048
    rounds: int = 14
    segment: int = 128
    known: int = 1 << 18
    seed: int = 11


def held_out(doc_id) -> F.Column:
    """Documents whose texts are not learnt. A null id is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_classes(words: Words, hashed: np.ndarray, how: Settings) -> np.ndarray:
    """The class of each word, 0 to classes - 2."""
    size = words.end - words.start
    last = words.buffer[words.end - 1].astype(np.uint64)
    for back in (2, 3):
        last = last << np.uint64(8) | words.buffer[np.maximum(words.end - back, words.start)]
    key = np.where(size <= 4, hashed, mix(last + np.uint64(1 << 40)))
    return (key % np.uint64(how.classes - 1)).astype(np.int16)


def word_counts(docs: DataFrame, how: Settings) -> DataFrame:
    """(h, cls, c): how often each word of the texts occurs; words are known by 64 bits of hash.

    A task adds up several million tokens before it puts anything out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            h, cls = (np.concatenate(x) for x in zip(*held))
            keys, first, counts = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cls[first]), pa.array(counts)], ["h", "cls", "c"])

        for batch in pieces(batches, 0):
            words = Words(encoded(batch.column(0).to_pylist()), SOLID)
            h = words.hashes()
            held.append((h, word_classes(words, h, how)))
            n += h.size
            if n > 3_000_000:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    made = docs.select("text").mapInArrow(run, "h bigint, cls smallint, c bigint")
    return made.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


class Known:
    """Counts of frequent words, looked up for many hashes at once."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.logs = h[order], np.log10(c[order] + 1.0)
        self.bits = max(1, int(self.h.size).bit_length() + 1)
        self.first = np.searchsorted(self.h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and log10(c + 1), 0 for the unknown."""
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        place = np.full(h.size, -1, np.int64)
        left = np.flatnonzero(at < stop)
        while left.size:
            same = self.h[at[left]] == h[left]
            place[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return place >= 0, np.where(place >= 0, self.logs[place], 0.0) if self.h.size else np.zeros(h.size)


def _known_words(counts: DataFrame, most: int) -> Known:
    """The most frequent words, at most ``most``: all words whose count reaches a bound found from a histogram."""
    level = F.floor(F.log2("c") * 8).cast("int")
    rows = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    least, total = None, 0
    for l, n in rows:
        if total + n > most:
            break
        least, total = l, total + n
    table = counts.where(level >= least if least is not None else F.lit(False)).select("h", "c").toPandas()
    return Known(table["h"].to_numpy(dtype=np.int64).view(np.uint64), table["c"].to_numpy(dtype=np.float64))


def _sequences(docs: DataFrame, known: Known, how: Settings) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known and log10 sums over frequent words, classes, and the other words."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.int16(how.classes - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in pieces(batches, 2):
            words = Words(encoded(batch.column(2).to_pylist()), SOLID)
            h = words.hashes()
            owner, n = words.owner(), len(words.data)
            cls = word_classes(words, h, how)
            good, logs = known.look_up(h)
            stops = words.first + words.counts
            rest = np.flatnonzero(~good)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[rest], minlength=n))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(words.counts + 1, pa.int64()),
                    pa.array(np.bincount(owner[good], minlength=n), pa.int64()),
                    pa.array(np.bincount(owner, logs, n)),
                    pa.array([np.append(cls[a:b], end).tobytes() for a, b in zip(words.first, stops)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[rest].view(np.int64))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_frequent", "logs", "classes", "rest"],
            )

    columns = "n_tokens bigint, n_frequent bigint, logs double, classes binary, rest array<bigint>"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, {columns}")


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # state x class


def _first_model(prior: np.ndarray, how: Settings) -> Model:
    rng = np.random.default_rng(how.seed)
    emit = prior * rng.gamma(1.0, 1.0, (how.states, how.classes))
    move = np.full((how.states, how.states), 0.3 / how.states) + 0.7 * np.eye(how.states)
    return Model(np.full(how.states, 1 / how.states), move, emit / emit.sum(axis=1, keepdims=True))


def expected(model: Model, rows: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, moves, emissions) of padded segments by scaled forward and backward recursion.

    ``rows`` is segment x place, ``sizes`` their lengths in falling order, ``starts`` marks those that begin a text.
    """
    k, (n, width) = model.start.size, rows.shape
    # States come before segments in all arrays, so that every step works along rows as long as the segments are many.
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    seen = np.take(emit, np.ascontiguousarray(rows.T), axis=1)
    alpha = np.empty((width, k, n), np.float32)
    scale = np.ones((width, n), np.float32)
    active = np.searchsorted(-sizes, -np.arange(width), side="left").tolist()
    # A segment within a text begins from the long-run shares of the states.
    inner = _long_run(model.move).astype(np.float32)
    now = np.where(starts, model.start.astype(np.float32)[:, None], inner[:, None]) * seen[:, 0]
    back = np.ascontiguousarray(move.T)
    for t in range(width):
        m = active[t]
        if t:
            now = back @ alpha[t - 1, :, :m]
            now *= seen[:, t, :m]
        total = now.sum(axis=0)
        scale[t, :m] = total
        np.divide(now, total, out=alpha[t, :, :m])
    moves = np.zeros((k, k))
    gamma = alpha
    beta = np.ones((k, n), np.float32)
    for t in range(width - 1, 0, -1):
        m = active[t]
        ahead = beta[:, :m] * seen[:, t, :m]
        ahead /= scale[t, :m]
        moves += alpha[t - 1, :, :m] @ ahead.T
        gamma[t, :, :m] *= beta[:, :m]
        beta[:, :m] = move @ ahead
    gamma[0] *= beta
    valid = np.arange(width)[:, None] < sizes[None, :]
    flat = rows.T[valid]
    emissions = np.stack([np.bincount(flat, gamma[:, s][valid], emit.shape[1]) for s in range(k)])
    return gamma[0][:, starts].sum(axis=1, dtype=np.float64), moves * model.move, emissions


def _long_run(move: np.ndarray) -> np.ndarray:
    share = np.full(move.shape[0], 1 / move.shape[0])
    for _ in range(60):
        share = share @ move
    return share / share.sum()


def _segments(sequences: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All tokens of the sequences as padded segments, some thousand at a time, longest first."""
    parts = [(s[i : i + 2 * width], i == 0) for s in sequences for i in range(0, len(s), 2 * width)]
    parts.sort(key=lambda p: -len(p[0]))
    for low in range(0, len(parts), 1024):
        part = parts[low : low + 1024]
        sizes = np.array([len(p[0]) // 2 for p in part])
        rows = np.zeros((len(part), int(sizes[0])), np.int16)
        rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(p[0] for p in part), np.int16)
        yield rows, sizes, np.array([p[1] for p in part])


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], prior: np.ndarray) -> Model:
    """The model that expected counts ask for, smoothed so that no class or move is impossible."""
    start, moves, emissions = counts[0] + 1, counts[1] + 1, counts[2] + 20 * prior
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=1, keepdims=True))


def _summed(model: Model, sequences: list[bytes], how: Settings):
    total = [np.zeros(how.states), np.zeros((how.states, how.states)), np.zeros((how.states, how.classes))]
    for rows, sizes, starts in _segments(sequences, how.segment):
        for t, x in zip(total, expected(model, rows, sizes, starts)):
            t += x
    return total


def train(sequences: DataFrame, prior: np.ndarray, how: Settings) -> Model:
    """Baum-Welch over the column ``classes`` of all rows in every round; only sums of the model's own size reach the driver."""
    model = _first_model(prior, how)
    for _ in range(0 if sequences.isEmpty() else how.rounds):
        model = improved(_round(sequences, model, how), prior)
    return model


def _round(sequences: DataFrame, model: Model, how: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sent = sequences.sparkSession.sparkContext.broadcast(model)
    k, c = how.states, how.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + k * c)
        for batch in pieces(batches, 0, 1 << 22):
            total += np.concatenate([x.ravel() for x in _summed(sent.value, batch.column(0).to_pylist(), how)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "v"])

    sums = sequences.select("classes").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(k + k * k + k * c)
    total[sums["i"].to_numpy(dtype=np.int64)] = sums["v"].to_numpy(dtype=float)
    return total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, c)


def forward_log10(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each whole class sequence, by the scaled forward recursion over all at once."""
    order = np.argsort([-s.size for s in sequences], kind="stable")
    sizes = np.array([sequences[i].size for i in order])
    out = np.zeros(sizes.size)
    if not sizes.size or sizes[0] == 0:
        return out
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    table, total = np.ascontiguousarray(model.emit.T), np.zeros(sizes.size)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    state, product = np.tile(model.start, (sizes.size, 1)), np.ones(sizes.size)
    for t in range(int(sizes[0])):
        m = int(active[t])
        state = (state[:m] @ model.move if t else state[:m]) * table[flat[first[:m] + t]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        product[:m] *= scale
        # Factors are multiplied up before their logarithm is taken; a class is never rarer than 1e-12 here.
        if t % 16 == 15:
            total += np.log10(product)
            product[:] = 1
    out[order] = total + np.log10(product)
    return out


def text_scores(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words without ASCII white space, A-Z lower-cased, and one end. Learnt are all rows that are not held out;
    null and empty texts are an end alone. The model's probability of a word is that of its class given the words
    before, by the hidden states, times (c + 1) / (n + v + 1) within the class, whose n tokens have v distinct words; so
    unseen words have the probability of one more. Repeated rows are learnt as often as they occur. An empty table gives
    an empty result. Other columns are not read.
    """
    reach_workers(docs.sparkSession)
    learnt = docs.where(~held_out(F.col("doc_id")))
    counts = stage(word_counts(learnt, how), "counts")
    known = _known_words(counts, how.known)
    by_class = np.zeros((2, how.classes))
    for r in counts.groupBy("cls").agg(F.sum("c"), F.count("*")).collect():
        by_class[:, r[0]] = r[1], r[2]
    rows = stage(_sequences(docs, known, how).withColumn("row", F.monotonically_increasing_id()), "sequences")
    ends = rows.where("not held_out").count()
    tokens, distinct = float(by_class[0].sum() + ends), float(by_class[1].sum() + (ends > 0))
    prior = (np.append(by_class[0][:-1], ends) + 1) / (tokens + how.classes)
    model = train(rows.where("not held_out").select("classes"), prior, how)
    within = np.log10(by_class.sum(axis=0) + 1)
    within[-1] = 0.0
    sent = docs.sparkSession.sparkContext.broadcast((model, within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, within = sent.value
        for batch in pieces(batches, 1, 1 << 23):
            sequences = [np.frombuffer(b, np.int16) for b in batch.column(1).to_pylist()]
            spent = [float(within[s].sum()) for s in sequences]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forward_log10(model, sequences) - spent)], ["row", "classes_score"])

    scored = rows.select("row", "classes").mapInArrow(run, "row bigint, classes_score double")
    rare = (
        rows.select("row", F.explode("rest").alias("h")).join(counts.select("h", "c"), "h")
        .groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare"), F.count("*").alias("n_rare"))
    )
    logs = F.col("logs") + F.coalesce("rare", F.lit(0.0))
    end_log = float(np.log10(ends + 1))
    return (
        rows.drop("classes", "rest").join(scored, "row").join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
            F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
            (logs + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
            (logs + F.col("classes_score")).alias("score"),
        )
    )
