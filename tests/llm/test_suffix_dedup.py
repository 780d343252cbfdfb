"""Repeated strings against a brute-force scan of every window."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from clickloom.llm import suffix_dedup


def brute(rows):
    """Per row in corpus order: bytes, removed bytes, spans, rest."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def found(frame):
    rows = suffix_dedup.deduplicated(frame).select(
        "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("left", 256).alias("h")
    )
    return sorted(tuple(r) for r in rows.collect())


def letters(rng, n, alphabet="abcdefghij é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [letters(rng, n) for n in (99, 100, 101, 130, 260, 700)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(letters(rng, rng.randrange(120)))
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            parts.append(p[cut:] if rng.random() < 0.5 else p[: len(p) - cut])
        rows.append((rng.randrange(10**6), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_passages(docs, small_batches, seed):
    rows = corpus(seed)
    assert found(docs(*rows)) == brute(rows)


@pytest.mark.parametrize("together", [0, 2, 256])
def test_triggers_with_many_phrases(docs, small_batches, monkeypatch, together):
    """Whether phrases meet whole or suffix by suffix changes nothing."""
    rows = corpus(9) + [(7, "ab" * 900), (8, "ba" * 400), (9, "a" * 1000)]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    assert found(docs(*rows)) == brute(rows)


def test_segments(monkeypatch):
    rng = random.Random(1)
    text = letters(rng, 2000).encode()
    whole = {(g, w) for _, low, n, g, w in _phrases([text]) for _ in (0,)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 333)
    suffix_dedup.Rolling._powers.clear()
    starts = sorted(s for _, low, n, _, _ in _phrases([text]) for s in range(low, low + n))
    suffix_dedup.Rolling._powers.clear()
    assert starts == list(range(len(text) - 99)) and whole


def _phrases(texts):
    return [row for part in suffix_dedup.parse(texts) for row in zip(*(c.tolist() for c in part))]


def test_odd_rows(docs):
    long = "x1y2" * 40
    rows = [(3, long), (1, long + "tail"), (3, long), (None, "n" + long), (5, None), (6, ""), (7, "é" * 60), (8, "é" * 49),
            (9, "z" * 99), (10, "z" * 100), (11, "z" * 300)]
    assert found(docs(*rows, extra="uid long, doc long")) == brute(rows)


def test_group_of_copies(docs, small_batches):
    rng = random.Random(2)
    text = letters(rng, 400)
    rows = [(i, text if i % 3 else text[:150] + str(i) + text[150:]) for i in range(90)]
    assert found(docs(*rows)) == brute(rows)


def test_text_column(docs):
    rng = random.Random(6)
    passage = letters(rng, 150, "abcdef é")
    frame = docs("first " + passage, "zweite ü" + passage + "ü ende", None, "", extra="spans long")
    left = suffix_dedup.without_repeats(frame)
    assert left.columns == frame.columns and left.dtypes == frame.dtypes
    rows = {r.doc_id: r for r in left.collect()}
    assert rows[1].text == "first " + passage
    assert rows[2].text.startswith("zweite") and rows[2].text.endswith(" ende")
    assert rows[2].n_chars == len(rows[2].text)
    assert rows[3].text is None and rows[4].text == ""


def test_empty_table(docs):
    assert found(docs()) == []
