"""Repetition rules by brute force; weak labels by held-out accuracy."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.llm import quality_rules, weak_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def inside(words, n):
    """Positions in n-word windows that occur twice or more."""
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = Counter(windows)
    return {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(n)}


def brute(text, limits):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            line_chars += sum(map(len, WORD.findall(line)))
        if WORD.search(line):
            seen.add(line)
    repeated = len(inside(words, 3))
    base = len(words) < 50 or 100 * repeated > 50 * len(words)
    fails = line_chars > limits.lines * chars or symbols > limits.symbols * len(words)
    for n, share in limits.repeated.items():
        fails |= sum(len(words[i]) for i in inside(words, n)) > share * chars
    return len(words), chars, symbols, lines, repeated, base, not base and not fails


def scored(frame):
    found = weak_quality.featured(frame)
    return weak_quality.scored(found, *weak_quality.learned(found))


def texts():
    rng = random.Random(1)
    some = [f"w{rng.randrange(200)}é" for _ in range(400)]
    out = [None, "", " \n\t", "one two", "a b c d", " ".join(some), "dup line here\n" * 40, "x " * 60, "$$$ " * 70]
    for _ in range(30):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(40, 160))]
        block = words[:12]
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at:at] = block
        glue = [rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in words]
        out.append("".join(w + g for w, g in zip(words, glue)))
        out.append(" ".join(words) + " |" * rng.randrange(30))
    return out


def test_rules_against_brute_force(docs, small_batches):
    limits = quality_rules.Limits()
    all_texts = texts()
    frame = docs(*all_texts, extra="n_words long, rules long")
    rows = quality_rules.measured(frame).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        m = r.rules
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, m.kept)
        assert got == brute(r.row.text, limits), r.row.text
    kept = quality_rules.rejected_dropped(frame)
    assert kept.columns == frame.columns and 0 < kept.count() < len(all_texts)


def test_empty_tables(docs):
    assert quality_rules.measured(docs()).collect() == []
    assert scored(docs()).collect() == []


def test_given_labels(spark):
    """Held-out: the scorer never sees ``labels.quality``."""
    sf = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored(frame).select(F.col("row.doc_id").alias("doc_id"), "kept").join(truth, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean)
    assert sum(bad) <= 0.15 * len(bad)


def test_odd_rows(docs):
    frame = docs(None, "", "a b c", "same", "same", "\u0000", extra="score long, kept long")
    rows = scored(frame).collect()
    assert len(rows) == 6
    assert len({(r.score, r.pattern) for r in rows if r.row.doc_id in (4, 5)}) == 1
    assert all(r.row.score == 7 for r in rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)


def test_scores_do_not_depend_on_the_layout(spark, docs):
    """Same rows in other files, orders and batches, with a sample smaller than the table and copies."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 90))) + "\n# x" * (i % 9) for i in range(60)]
    frame = docs(*texts, *[(100 + i, texts[i % 3]) for i in range(40)])
    runs = []
    for rows in (frame.coalesce(1), frame.repartition(7), frame.orderBy(F.col("doc_id").desc())):
        found = weak_quality.featured(rows)
        labels, scorer = weak_quality.learned(found, size=20)
        scored_rows = weak_quality.scored(found, labels, scorer).select("row.doc_id", "score", "kept")
        runs.append(sorted(map(tuple, scored_rows.collect())))
    assert runs[0] == runs[1] == runs[2]


def test_very_long_texts(docs):
    long = " ".join(f"w{i % 5000}" for i in range(150_000))
    frame = docs("x" * 1_000_000, long, ("y" * 300_000 + "\n") * 3, "short")
    rows = {r.row.doc_id: r.rules for r in quality_rules.measured(frame).collect()}
    assert rows[1].n_words == 1 and rows[2].n_words == 150_000 and rows[2].n_repeat_words == 150_000
    assert rows[3].n_dup_lines == 2 and rows[3].word_chars == 900_000
    assert scored(frame).count() == 4


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(2)
    n = len(weak_quality.LABELLERS)
    right = [0.95, 0.9, 0.85, 0.9, 0.8, 0.95, 0.9, 0.7, 0.6]
    counts, truth = Counter(), []
    for _ in range(6000):
        good = rng.random() < 0.8
        ballot = []
        for a in right[:n]:
            if rng.random() < 0.1:
                ballot.append(weak_quality.ABSTAIN)
            else:
                hit = rng.random() < a
                ballot.append(weak_quality.GOOD if hit == good else weak_quality.BAD)
        counts[weak_quality.code(ballot)] += 1
        truth.append((weak_quality.code(ballot), good))
    labels = weak_quality.aggregate(counts)
    assert labels.prior == pytest.approx(0.8, abs=0.03)
    for i, a in enumerate(right[:n]):
        assert labels.accuracy[i, 1, weak_quality.GOOD] == pytest.approx(0.9 * a, abs=0.04)
    hits = sum((labels.posterior[c] >= 0.5) == g for c, g in truth)
    assert hits >= 0.97 * len(truth)
