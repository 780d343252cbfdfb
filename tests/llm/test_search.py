"""Nearest neighbours against all products; the URL filter against its SQL and by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import neighbours, url_filter


def product(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if v and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.float32(v).astype(float))
    out = {}
    for q in good:
        if q % 20 == 0:
            scores = sorted((-product(good[q], v), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    out = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, **more).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [ranks[i + 1] for i in range(len(ranks))] for q, ranks in out.items()}


def test_few_vectors_are_all_ranked(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(45)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # copies: ties by id
    rows += [(60, None), (80, [0.0] * 8), (140, [float("nan")] * 8), (160, [1.0, None] * 4), (180, [float("inf")] * 8),
             (None, [1.0] * 8), (200, []), (220, [1.0, 2.0])]
    rows += [(5, rows[5][1]), (5, rows[5][1])]
    got, wanted = found(spark, rows), brute(rows[:-4])
    wanted.pop(220, None)
    rows = [r for r in rows if r[0] != 220]
    wanted = brute(rows)
    assert set(got) == set(wanted)
    for q in wanted:
        assert got[q] == wanted[q]


def test_recall_on_many(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.3, 2, size=(3000, 1))
    vectors[500:900] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(np.float32(vectors))]
    got, wanted = found(spark, rows, leaves=120), brute(rows)
    assert set(got) == set(wanted)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 20 * len(wanted)
    for q, pairs in got.items():
        exact = {i: s for i, s in pairs}
        assert len(pairs) == 20 and q not in exact
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


def test_no_vectors(spark):
    assert found(spark, [(20, None)]) == {}


RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
]
URLS = [
    (1, "http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    (2, "https://a.www.example.com/en/?q=://x", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (3, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (4, "http://x.com", "x.com", "", None, "allow"),
    (5, "http://x.net/es", "x.net", "/es", None, "allow"),
    (6, "http://x.net/es/#top", "x.net", "/es/", "net/es/", "block"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme/en/", "", "", None, "allow"),
    (9, "http://www.bad.org/a/index.html?x=1", "www.bad.org", "/a/index.html", None, "block"),
    (9, "https://BAD.org/a/", "bad.org", "/a/", None, "block"),
    (10, "http://bad.org/b", "bad.org", "/b", None, "allow"),
    (11, "", "", "", None, "allow"),
    (12, "://É.net/es/", "É.net", "/es/", "net/es/", "block"),
    (13, "a\nb://bad.org/a#x", "bad.org", "/a", None, "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.org/a",)], "canonical string")
    got = url_filter.judged(pages, RULES, listed, 1).select("row.page_id", "row.url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(URLS, key=str)
    assert url_filter.judged(pages.limit(0), RULES, listed.limit(0), 0).collect() == []
    assert all(r.rule is None for r in url_filter.judged(pages, [], listed, 1).collect())


def page(body, heading="some"):
    return f"<html><body><nav>x</nav><article>\n<h1>{heading}</h1>{body}</article><p>more</p></body></html>"


def test_a_list_of_what_pages_publish(spark):
    bad = "one two\n\nthree & <four> \"five\""
    long = "word " * 300_000
    html = page("<p><b>one</b> two</p> <p>three &amp; &lt;four&gt; &quot;five&quot;</p>")
    pages = [
        (1, "http://plain.org/a", html), (1, "http://plain.org/a", html),  # no telling word, listed
        (2, "https://www.plain.org/a/?x=1", page("other")),  # judged by its URL, not by its own article
        (3, "http://casino-spam.org/b", page("clean")), (4, "http://casino-spam.org/c", None),
        (5, None, html), (6, "no scheme", html), (7, "http://long.org/" + "z" * 100_000, page(f"<p>{long}</p>")),
        (8, "http://empty.org/", page("")), (9, "http://none.org/", "one two three"), (10, "http://some.com/a", html),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    texts = spark.createDataFrame([(bad,), (bad,), ("",), (None,), (long,)], "text string")
    texts = texts.select("text", url_filter.text_digest(url_filter.plain_text(F.col("text"))).alias("digest"))
    listed = url_filter.listed_urls(pages, texts)
    assert sorted(r[0] for r in listed.collect()) == ["long.org/" + "z" * 100_000, "plain.org/a", "some.com/a"]
    got = url_filter.judged(pages, RULES, listed, 3).select("row.page_id", "verdict").collect()
    assert {r[0] for r in got if r[1] == "block"} == {1, 2, 7} and len(got) == 11
    assert url_filter.listed_urls(pages, texts.limit(0)).collect() == []
    assert url_filter.listed_urls(pages.limit(0), texts).collect() == []


@pytest.mark.parametrize("size", [1, 1000, 20_000])
def test_bloom_has_no_false_negatives(spark, size):
    keys = spark.range(size).select(F.xxhash64("id").alias("key"))
    table = url_filter.bloom(keys, size)
    passes = url_filter.maybe_listed(table)
    assert keys.where(~passes("key")).count() == 0
    others = spark.range(10**9, 10**9 + 20_000).select(F.xxhash64("id").alias("key"))
    assert others.where(passes("key")).count() < 0.02 * 20_000
