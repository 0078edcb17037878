"""Main text, addresses, licences, archives and search against plain versions."""

import base64
import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, licenses, topk, urls, warc
from tidemark.llm.queries import URL_RULES, QUERIES, SQL

PAGE = """<html><head><title>t</title></head><body class=home><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div id="main"><div class="post"><h2>Title &amp; more</h2><p>First  paragraph, with, commas and a
length to score.<p>Second <a href="x>y">link</a> para &lt;b&gt; &#233;</p><ul><li>one<li>two</ul><script>var a="<p>no</p>";</script>
<!-- gone --><blockquote><p>quote</p></blockquote></div><div class="comments"><p>Great, great, great, great, great post</p></div></div>
<aside>side</aside><div class=cookie-notice>cookies</div><form><p>ask</p></form><footer>foot</footer></body>"""


def test_main_text():
    want = ["Title & more", "First paragraph, with, commas and a length to score.", "Second link para <b> é", "one", "two", "quote"]
    assert html.main_text(PAGE).split("\n") == want
    odd = {None: "", "": "", "plain": "plain", "<p>": "", "<p>a<br>b<p>c": "a b\nc", "a &amp;&nbsp;b": "a & b", "<script>x": "", "<!-- x": ""}
    assert {k: html.main_text(k) for k in odd} == odd
    assert html.main_text("<article><h1>A</h1>" + "<p>word, word</p>" * 3 + "<nav>n</nav></article><footer>f") == "A" + "\nword, word" * 3


def test_siblings_of_the_best_container_stay():
    """No article or main: heading, intro, closing words and a short second section stand beside the best container."""
    ten = "".join(f"<p>Paragraph {i}, with words, and more words.</p>" for i in range(10))
    page = f"<div id=wrap><h1>Title</h1><p>A long intro, in words</p>loose<div class=text>{ten}</div><h2>Second</h2><div><p>Short.</p></div>"
    page += "<ul><li><a href=x>one</a><li><a href=y>two</a></ul><blockquote>Quote</blockquote><p>Closing</p><footer>f</footer></div>"
    got = html.main_text(page).split("\n")
    assert got[:3] == ["Title", "A long intro, in words", "loose"] and len(got) == 17
    assert got[13:] == ["Second", "Short.", "Quote", "Closing"]


def test_main_text_frame(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "u", "<b>" * 5000 + "y", "x")], "page_id long, url string, html string, text string")
    got = html.extract_text(frame)
    assert got.columns == ["page_id", "url", "text"]
    assert [len(r["text"]) for r in got.collect()] == [len(html.main_text(PAGE)), 0, 1]
    assert html.extract_text(frame.limit(0)).count() == 0


ADDRESSES = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/x?y", "ftp://x.net/fr/", "x.net/fr/", None, "", "http://net/es/1#a", "http://com",
    "http://notexample.com/en/", "http://b.org/é/ü", "http://a.com?x", "://", "http://x.net/FR/", "a://b://c/d", "http://q.net/fr\n/x",
]


def plain_parts(url):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), match[1]), match[2]) if match else ("", "")


def plain_rule(host, path):
    best = None
    for rule in URL_RULES:
        own, _, below = rule.place.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and len(rule.place) > len(best or ""):
            best = rule.place
    return best


def test_addresses(spark):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ADDRESSES * 2)], "page_id long, url string, host string, verdict string")
    got = urls.judged(frame, URL_RULES).collect()
    verdicts = {r.place: r.verdict for r in URL_RULES}
    for r in got:
        host, path = plain_parts(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, plain_rule(host, path))
        assert r["verdict"] == verdicts.get(r["rule"], "allow" if r["probability"] >= 0.5 else "block")
    assert urls.judged(frame.limit(0), URL_RULES).count() == 0


def test_address_model_learns(spark):
    rng = random.Random(1)
    rows = [(f"http://{rng.choice(['casino', 'betting'] if i % 2 else ['school', 'library'])}{rng.randrange(99)}.org/{rng.randrange(999)}", 1 - i % 2) for i in range(300)]
    labelled = spark.createDataFrame(rows[:200], "url string, label int")
    got = urls.judged(spark.createDataFrame(rows[200:], "url string, label int"), [], labelled).collect()
    assert np.mean([(r["verdict"] == "allow") == bool(r["label"]) for r in got]) > 0.95


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.\nMIT license, Apache License 2.0", None, "", "mit  LICENSE mit license", "summit license", "the gnu general public license v3 or later",
    "SPDX-License-Identifier: MIT", "CC BY-NC 4.0", "All rights reserved", "no notice here", "É mit licenseé", "general public license " * 300, "x" * 20_000,
]


def plain_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def plain_labels(text, rules):
    """All matches of all rules whose keyword stands in the words, less those inside another one."""
    words = " " + " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
    spans = []
    for ord_, rule in enumerate(rules):
        if f" {rule.keyword}" in words:
            spans += [(m.start(), -m.end(), ord_, rule.label) for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", words)]
    kept, reach = set(), -1
    for _, stop, _, label in sorted(spans):
        if -stop > reach:
            kept.add(label)
            reach = -stop
    return kept


def test_licences(spark):
    rules = licenses.signature_rules()
    assert len(rules) > 300 and len(set(rules)) == len(rules)
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS + TEXTS[:1])], "doc_id long, text string, row int, words int")
    got = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS + TEXTS[:1]):
        r, base = got[i], plain_base(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        assert set(filter(None, r["labels"].split(","))) == plain_labels(t, rules) | set(filter(None, base[4].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert "gpl-3.0-or-later" in got[5]["labels"].split(",") and "cc-by-nc-4.0" in got[7]["labels"]
    assert licenses.license_scan(frame.limit(0)).count() == 0


def test_archives(spark):
    rows = [(1, "u", "same"), (5, "u\r\nX: y", "same"), (3, None, "same"), (2, "v", None), (9, "v", ""), (None, "w", "lone"), (7, "é", "日本" * 60_000), (8, "x", "\x1f\x8b\x08" * 9)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archived(spark, frame).collect()}
    owners = {"same": 5, "": 9}
    for page, _, text in rows:
        data = (text or "").encode()
        label = base64.b32encode(hashlib.sha1(data).digest()).decode()
        owner = owners.get(text or "", page)
        assert got[page] == (len(data), label, "response" if owner == page else "revisit", None if owner == page else owner)
    kinds = {r["record_type"] for r in warc.archived(spark, frame, warc.Writing(least=5)).collect()}
    assert kinds == {"response"}
    assert warc.archived(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize("split", [7, 60, 100_000])
def test_every_split_owns_its_records(split):
    how = warc.Writing()
    parts = [warc._record(i, "u", os.urandom(i * 3) + b"\x1f\x8b\x08" * 4, b"\0" * 20, None, False, how) for i in range(60)]
    noise = b"\x1f\x8b\x08 no member " + zlib.compress(b"x")
    data = b"".join(p + (noise if i % 7 == 0 else b"") for i, p in enumerate(parts))
    found = [r for b in range(0, len(data), split) for r in warc.records(io.BytesIO(data), len(data), b, b + split)]
    assert [int(f["warc-record-id"].split(":")[-1].rstrip(">")) for _, f, _ in found] == list(range(60))


def plain_top(rows, k):
    for q, a in rows:
        if q % 20 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q))[:k]
            yield from ((q, i + 1, v, -s) for i, (s, v) in enumerate(best))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(0, 0.3, 6).round(2).tolist() for i in range(300)}
    vectors |= {i: [0.5] * 6 for i in range(300, 420)}
    rows = [(i, v) for i, v in vectors.items()] + [(7, [9.0] * 6), (500, None), (501, [None, 1.0]), (502, [float("nan")]), (520, [float("inf")]), (None, [1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    # Both rows with the id 7 are searched.
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in [*vectors.items(), (7, [9.0] * 6)]]
    how = topk.Settings(k=20, block=32, shard=100, chunk=8)
    got = sorted(map(tuple, topk.top_k(topk.whole_components(frame), F.col("vec_id") % 20 == 0, how).collect()))
    assert got == sorted(plain_top(whole, 20))
    assert topk.top_k(topk.whole_components(frame.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_pruned_and_large_numbers_exact():
    far = [topk.Block(np.arange(i * 50, i * 50 + 50), np.full((50, 4), 100 * (i == 3), np.int64)) for i in range(10)]
    seen = []
    for b in far:
        b.bounds = (lambda q, b=b, f=b.bounds: seen.append(b.ids[0]) or f(q))
    place, ids, score = topk.search(far, np.array([999]), np.ones((1, 4), np.int64), 5)
    assert ids.tolist() == [150, 151, 152, 153, 154] and score.tolist() == [400] * 5
    big = np.array([[1 << 60, 3]])
    assert topk.products(big, np.array([[1, 1], [1 << 60, 0]])).tolist() == [[(1 << 60) + 3, (1 << 63) - 1]]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_rows_with_one_id_are_all_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 23 + 1, [float(x) for x in rng.integers(-5, 6, 3)]) for i in range(90)]
    rows += [(20, [5.0, 5.0, 5.0])] * 30 + [(1, [1.0, 0.0, 0.0]), (1, [5.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    how = topk.Settings(k=6, block=8, shard=40, chunk=4)
    got = topk.top_k(topk.whole_components(frame), F.col("vec_id") % 20 == 0, how).collect()
    scores = sorted(
        ((sum(int(64 * a) * int(64 * b) for a, b in zip(q, c)), -j) for i, q in rows for j, c in rows if i == 20 and j != 20), reverse=True
    )[:6]
    assert [(r["score"], -r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == scores


def test_only_the_attributes_of_hidden_parts_hide_them():
    page = """<article><p title="a hidden gem">One, two.</p><p alt='display:none'>Three.</p><p data-id="menu">Four.</p>
    <p hidden>No.</p><p aria-hidden="TRUE">No.</p><p STYLE='color:red; display : none'>No.</p><p hidden="">No.</p><div class=menu>No.</div></article>"""
    assert html.main_text(page) == "One, two.\nThree.\nFour."
