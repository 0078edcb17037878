"""Quality scores by attention over passages: multiple-instance learning from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tidemark.llm.frames import free_name, pieces, reach_workers
from tidemark.llm.words import SOLID, Words, encoded

#: Kinds of bytes that are counted in a passage; characters beyond ASCII count by their bytes.
_SIGNS = "\n .,!?|#*%&$@:;/\\\"'()[]{}<>=+-_~^`"
_KIND = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(_SIGNS):
    _KIND[ord(_c)] = _i + 5
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KINDS = len(_SIGNS) + 5
_BUCKETS = 96
_SHAPES = 6
WIDTH = _KINDS + _SHAPES + _BUCKETS


@dataclass(frozen=True)
class Settings:
    """``max_docs`` labelled documents at most are learnt from, those with the least hash of their id.

    A passage has ``words`` words; a text of over ``most`` passages is cut into ``most`` longer ones, so that the whole
    text is read and a document's bag stays bounded.
    """

    max_docs: int = 4000
    words: int = 48
    most: int = 64
    hidden: int = 24
    attention: int = 12
    epochs: int = 24
    batch: int = 100
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)


def passages(data: list[bytes], how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and each text's number of passages, one at least."""
    words = Words(data, SOLID)
    raw = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    length = np.maximum(how.words, -(-words.counts // how.most))
    n = np.maximum(1, -(-words.counts // length))
    total = int(n.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.arange(n.size), n)
    first_word = words.first[text] + nth * length[text]
    # A passage's bytes reach from its first word to the next passage; the first also has what precedes it.
    begin = np.where(nth == 0, words.bounds[text], words.start[np.minimum(first_word, max(0, words.start.size - 1))] if words.start.size else 0)
    sizes = np.diff(np.concatenate((begin, [raw.size])))
    place = np.repeat(np.arange(total) * _KINDS, sizes)
    kinds = np.bincount(place + _KIND[raw], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float32)
    n_words = np.minimum(length[text], words.counts[text] - nth * length[text]).astype(np.int64)
    n_words = np.maximum(0, n_words)
    owner = np.repeat(np.arange(total), n_words)
    hashed = words.hashes()
    bucket = (hashed % np.uint64(_BUCKETS)).astype(np.int64)
    counts = np.bincount(owner * _BUCKETS + bucket, minlength=total * _BUCKETS).reshape(total, _BUCKETS)
    size = (words.end - words.start).astype(np.float64)
    per = np.maximum(1, n_words)
    means = np.bincount(owner, size, total) / per
    order = np.lexsort((hashed, owner))
    new = np.ones(order.size, bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=total) / per
    repeats = np.bincount(owner[1:][(hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])], minlength=total) / per
    shapes = np.stack(
        (means / 10, np.bincount(owner, size <= 3, total) / per, np.bincount(owner, size > 14, total) / per, distinct, repeats, np.log1p(n_words) / 4),
        axis=1,
    )
    share = np.sqrt(kinds / np.maximum(1, sizes)[:, None])
    return np.concatenate((share, shapes, np.sqrt(counts / per[:, None])), axis=1).astype(np.float32), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: Model, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Encodings h, gated attention weights alpha within each bag, their weighted mean z and the score s."""
    p, first = model.p, np.cumsum(n) - n
    h = np.tanh(((x - model.mean) / model.scale) @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    bag = np.repeat(np.arange(n.size), n)
    alpha = np.exp(e - np.maximum.reduceat(e, first)[bag])
    alpha /= np.add.reduceat(alpha, first)[bag]
    z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "bag": bag, "s": _sigmoid(z @ p["c"] + p["d"])}


def _gradients(model: Model, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, o = model.p, forward(model, x, n)
    h, t, g, alpha, bag, first = o["h"], o["t"], o["g"], o["alpha"], o["bag"], np.cumsum(n) - n
    ds = (o["s"] - y) / y.size
    dz = ds[:, None] * p["c"]
    to_alpha = (dz[bag] * h).sum(axis=1)
    de = alpha * (to_alpha - np.add.reduceat(alpha * to_alpha, first)[bag])
    gate = de[:, None] * p["w"]
    dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
    dh = alpha[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    dpre = dh * (1 - h * h)
    return {
        "W": ((x - model.mean) / model.scale).T @ dpre,
        "b": dpre.sum(axis=0),
        "V": h.T @ dt,
        "U": h.T @ dg,
        "w": (t * g).T @ de,
        "c": o["z"].T @ ds,
        "d": np.array(ds.sum()),
    }


def fit(bags: list[np.ndarray], y: np.ndarray, how: Settings) -> Model | None:
    """Trains on bags of passage features with labels in [0, 1] by Adam steps; None without any label."""
    if not bags:
        return None
    x = np.concatenate(bags)
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))
    rng = np.random.default_rng(how.seed)
    sizes = {"W": (WIDTH, how.hidden), "b": (how.hidden,), "V": (how.hidden, how.attention), "U": (how.hidden, how.attention), "w": (how.attention,), "c": (how.hidden,), "d": ()}
    model.p = {k: rng.normal(0, 1 / np.sqrt(s[0]) if len(s) else 0, s) for k, s in sizes.items()}
    model.p["b"], model.p["d"] = np.zeros(how.hidden), np.array(0.0)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        order = rng.permutation(len(bags))
        for low in range(0, order.size, how.batch):
            part = order[low : low + how.batch]
            grads = _gradients(model, np.concatenate([bags[i] for i in part]), np.array([len(bags[i]) for i in part]), y[part])
            step += 1
            for k, grad in grads.items():
                grad = grad + how.decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id) -> F.Column:
    """Documents kept for judging: no label of theirs is learnt. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Model | None:
    """Learns from at most ``how.max_docs`` labelled documents that are not held out.

    ``labels`` has doc_id and quality (0 or 1); several labels of a document are averaged, null ones ignored. Only the
    passages' features of those documents reach the driver, ``max_docs`` x ``most`` rows at most.
    """
    reach_workers(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.avg("quality").alias("y")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(how.max_docs)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            x, n = passages(encoded(batch.column(2).to_pylist()), how)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary())], ["id", "y", "x"]
            )

    made = rows.mapInArrow(run, "id string, y double, x binary").limit(how.max_docs).toPandas().sort_values(["id", "y"], kind="stable")
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in made["x"]]
    return fit(bags, made["y"].to_numpy(dtype=float), how)


def with_quality(docs: DataFrame, model: Model | None, how: Settings = Settings(), name: str = "score") -> DataFrame:
    """The rows with a column ``name``: the score of the whole text, 0 to 1. Only the text is used.

    Null and empty texts are one passage without words and get the model's score for that. Without a model nothing is
    known against any text, and the score is 1. A column called ``name`` is replaced, all others are kept.
    """
    reach_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col("text").alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, len(others)):
            if model is None:
                score = np.ones(batch.num_rows)
            else:
                score = forward(model, *passages(encoded(batch.column(len(others)).to_pylist()), how))["s"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*[f.name for f in others], name])

    return frame.mapInArrow(run, T.StructType([*others, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``predicted`` is 1 at ``threshold`` or more."""
    scored = with_quality(docs.select("doc_id", "text"), train(docs, labels, how), how)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, how: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    name = free_name(docs, "_score")
    return with_quality(docs, train(docs, labels, how), how, name).where(F.col(name) >= threshold).drop(name)
