"""The registered queries of this folder: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clusters, hmm, html, licenses, packing, phrases, pieces, quality, simhash, topk, urls, warc, winnow
from tidemark.llm.frames import reach_workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def piece_model() -> str:
    """Where this machine keeps the public piece model; TIDEMARK_PIECE_MODEL names another file."""
    if path := os.environ.get("TIDEMARK_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_tokenizer() -> str:
    """Where this machine keeps the public word tokenizer; TIDEMARK_WORD_TOKENIZER names another file."""
    if path := os.environ.get("TIDEMARK_WORD_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by whole-number inner product, of every row whose id is divisible by 20."""
    return topk.top_k(topk.whole_components(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


SQL["op1_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels of those that are not held out."""
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside ten-word windows of benchmark items."""
    return winnow.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL["op3_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS g FROM
    (SELECT *, least(len(w), 10) AS len, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS g FROM
    (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT len FROM iw) l WHERE i + l.len - 1 <= len(w)),
h AS (SELECT r, i, dw.len, item_id FROM dw JOIN iw USING (len, g)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + len)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS k, string_agg(s, ',' ORDER BY s) AS s FROM
    (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(t.k, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
    coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


#: The given rules on hosts and paths.
URL_RULES = [
    urls.Rule("com/", "allow"),
    urls.Rule("example.com/en/", "block"),
    urls.Rule("www.example.com/en/", "allow"),
    urls.Rule("net/es/", "block"),
    urls.Rule("net/fr/", "block"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule, or by the model learnt from the pages that a rule judges."""
    return urls.judged(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query
def op5_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the unigram base and the hidden Markov model."""
    return hmm.text_scores(read(spark, sf_dir, "documents"))


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids and the text they decode to, as digests."""
    return pieces.token_digest(read(spark, sf_dir, "documents"), piece_model())


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = html.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and the labels of the signature rules."""
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into web archives and read back."""
    return warc.archived(spark, read(spark, sf_dir, "pages"))


# Five hexadecimal digits of the SHA-1 are four base32 letters.
SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS owner FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')
        AS payload_digest,
    CASE WHEN page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o
"""


@query
def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint and the least id reachable over at most 2 differing bits."""
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two and three words."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


SQL["op11_collocations"] = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS ph, k, count(*) AS a FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND a >= 10),
cuts AS (SELECT c.lang, c.ph, c.k, c.a, x.a AS l, y.a AS r, j,
    CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:j]
    JOIN f y ON y.lang = c.lang AND y.ph = c.ph[j + 1:]),
worst AS (SELECT lang, ph, a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM cuts GROUP BY lang, ph, a),
longer AS (SELECT lang, ph, max(a) AS m FROM (SELECT lang, ph[1:2] AS ph, a FROM c WHERE k = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE k = 3)
    GROUP BY lang, ph),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM worst LEFT JOIN longer USING (lang, ph)
    WHERE m IS NULL OR 100 * m < 50 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster after ten rounds, with the distances."""
    return clusters.clustered(read(spark, sf_dir, "embeddings"))


def _cluster_sql(how: clusters.Settings) -> str:
    """The rounds one after the other, as rows of (vector, component)."""
    away = "sum((x.x - c.x) * (x.x - c.x))"
    blocks = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding,
    lambda x: CAST(floor({how.factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, embedding AS e FROM embeddings
    WHERE len(embedding) = {how.size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM k)",
        f"""c0 AS MATERIALIZED (SELECT j, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM
    (SELECT v, row_number() OVER (ORDER BY sha256(concat('{how.seed}:', coalesce(CAST(vec_id AS VARCHAR), 'null'))), e) - 1 AS j FROM k)
    WHERE j < {how.k})""",
    ]
    for i in range(how.rounds + 1):
        blocks.append(
            f"""a{i} AS MATERIALIZED (SELECT r, arg_min(j, (a, j)) AS j, min(a) AS a FROM
    (SELECT r, j, {away} AS a FROM x JOIN c{i} c USING (d) GROUP BY r, j) GROUP BY r)"""
        )
        if i < how.rounds:
            blocks.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT j, d, CASE WHEN n IS NULL THEN x ELSE (s - (((s % n) + n) % n)) // n END AS x
    FROM c{i} LEFT JOIN (SELECT j, d, sum(x.x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY j, d) USING (j, d))"""
            )
    n = how.rounds
    return f"""WITH {','.join(blocks)},
h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{n} GROUP BY j),
t AS (SELECT j, sum(a) AS t FROM a{n} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(a AS BIGINT) AS distance, CAST(t AS BIGINT) AS cluster_inertia,
    CAST((SELECT sum(a) FROM a{n}) AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{n} JOIN k USING (r) JOIN h USING (j) JOIN t USING (j)"""


SQL["op12_clusters"] = _cluster_sql(clusters.Settings())


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2,048 tokens and its place there."""
    return packing.packed(read(spark, sf_dir, "documents"), word_tokenizer())
