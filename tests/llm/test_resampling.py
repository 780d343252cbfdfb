"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clickloom.llm import resampling as R

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, percent, min_words, buckets, longest):
    def found(text):
        words = WORD.findall((text or "").translate(UPPER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in found(t)[1]:
                out[b] += 1
        return out

    s, t = counts(text for _, text in docs), counts(target)
    gain = [
        math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets))))
        for a, b in zip(s, t)
    ]
    out = []
    for i, text in docs:
        words, hit = found(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in hit)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, words, len(hit), weight, weight + noise, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], start=1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


TARGET = ["alpha beta Gamma, alpha", None, "", "straße ÉCOLE 12x"]
TEXTS = [
    None, "", "ALPHA beta", "alpha-beta_gamma\x7fdelta", "Straße École école 日本 12X y", "same words here", "same words here",
    "nothing in common at all", "alpha " * 40, " ".join(f"w{i}" for i in range(300)),
]


def check(spark, frame, docs, percent=40, min_words=2, buckets=50, longest=1):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = R.resampled(frame, target, percent, min_words, buckets=buckets, longest=longest).collect()
    got = [(r.row.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in rows]
    assert sorted(got, key=repr) == brute(docs, TARGET, percent, min_words, buckets, longest)


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("percent", [0, 40, 100])
def test_whole_result(spark, docs, small_batches, percent, longest):
    rows = list(enumerate(TEXTS * 3))
    check(spark, docs(*rows, extra="score long, rank long, uid long, buckets long"), rows, percent, longest=longest)


def test_ties_and_null_ids(spark, docs):
    """Repeated rows and null ids at the cutoff: as many rows as asked for, in order."""
    rows = [(i, "same words here") for i in (5, 5, 5, 2, None, None, 9, 9)]
    frame = docs(*rows)
    for percent in range(0, 101, 12):
        check(spark, frame, rows, percent)


def test_empty_tables(spark, docs):
    check(spark, docs(), [])
    none = spark.createDataFrame([], "text string")
    out = R.resampled(docs((1, "a b c"), (2, "a")), none, 100, 1)
    assert sorted(r["rank"] for r in out.collect()) == [1, 2]


def test_very_long_text(spark, docs):
    rows = [(1, "alpha é " * 400_000), (2, "x" * 1_000_000), (3, "alpha")]
    check(spark, docs(*rows), rows, 100, 1)


@pytest.mark.parametrize("wanted", [1, 2, 5, 6, 999, 1000])
def test_cutoff(spark, wanted):
    rows = spark.range(1000).select((F.col("id") * F.col("id") % 97 - 40).alias("k"))
    keys = sorted(r.k for r in rows.collect())
    c = keys[wanted - 1]
    assert R.cutoff(rows, F.col("k"), wanted) == (c, sum(k < c for k in keys), keys.count(c))


def test_cutoff_at_the_ends_of_bigint(spark):
    rows = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], "k long")
    assert [R.cutoff(rows, F.col("k"), n)[0] for n in (1, 2, 3)] == [-(2**63), 0, 2**63 - 1]
