"""The pipeline on a small table against plain loops over what its first stage keeps."""

import hashlib
import random
import re
import struct

import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm import winnow
from tidemark.llm.queries import piece_model

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, `root` string, sig string"


def plain_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """The rows that stay: all without words or id, and the least (id, place) of each group over links of 0.8 or more."""
    sets = [plain_sets(r[1]) if r[0] is not None else set() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else (i,), []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_contaminated(text, items):
    words = plain_words(text)
    for item in items:
        own = plain_words(item)
        if not own:
            continue
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], int(d[3] == "good"), 0) for d in docs if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_like_plain_loops(spark, tmp_path):
    rng = random.Random(12)
    good = [f"word{i}" for i in range(300)]
    junk = [f"JUNK{i}$" for i in range(40)]
    texts = []
    for i in range(60):
        words = [rng.choice(good) for _ in range(60)]
        texts.append(("good", " ".join(words)))
        for changes in ([1] if i % 3 == 0 else [2] if i % 3 == 1 else []):  # similarity of about 0.83 and 0.69
            copy = list(words)
            for at in rng.sample(range(8, 50), changes):
                copy[at] = f"other{i}"
            texts.append(("good", "  ".join(copy).replace("word1 ", "WORD1\t")))
        if i % 10 == 0:
            texts += [texts[-1]] * 3
        texts.append(("junk", " ".join(rng.choice(junk) for _ in range(50))))
    items = [(1, " ".join(f"word{i}" for i in range(40, 60))), (2, "short item here"), (3, None), (4, ""), (5, "...")]
    texts += [("good", texts[0][1] + " " + items[0][1].upper()), ("good", texts[2][1] + ", Short ITEM here!"), ("good", texts[4][1] + " short item")]
    texts += [("good", None), ("good", ""), ("good", " \n"), ("good", "one two three"), ("good", " ".join(good * 40))]
    docs = [(i, t, "en", s, len(t or ""), 1, "x", "y") for i, (s, t) in enumerate(texts)]
    docs += [(None, texts[0][1], "en", "good", 1, 1, "x", "y"), (3, texts[8][1] + " tail", None, "good", 1, 1, "x", "y"), docs[0]]
    write(spark, tmp_path, docs, items)

    sf = str(tmp_path)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, frame, sf)
    assert kept.columns == frame.columns
    rows = [tuple(r) for r in kept.collect()]
    assert {r[3] for r in rows if len(r[1] or "") > 40} == {"good"}
    # Rows told apart by nothing but their place may stand in for each other, so texts and ids are compared.
    single = plain_groups(rows)
    clean = [r for r in single if not plain_contaminated(r[1], [t for _, t in items])]
    assert len(rows) - 20 > len(single) > len(clean) > 60
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = []
    for r in clean:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        want.append((str(r[0]), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(want)


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("before, most", [("64m", 5 << 20), ("512k", 1 << 20)])
def test_python_workers_get_small_batches(spark, before, most):
    docs = spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "concat(id, repeat(' some words', 5000)) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    given = spark.conf.get(ARROW)
    spark.conf.set(ARROW, before)
    try:
        for _, step in corpus_pipeline.STAGES[-1:]:
            step(spark, docs, "")
        seen = docs.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.set(ARROW, given)
    assert sum(r["n"] for r in seen) == 400
    assert max(r["size"] for r in seen) <= most


def test_only_doubtful_texts_are_joined_with_the_lost_rows(spark):
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 30 :] if i % 7 == 0 else [f"x{i}"] * 20)) for i in range(100)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[30:45]))], "item_id long, text string")
    out = winnow.without_passages(docs, items)
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(100) if i % 7}
    # Both branches, that without a join too, tell rows apart by the filter.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("ArrowEvalPython") >= 2
