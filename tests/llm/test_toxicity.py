"""The field's passes against sums over all taggings; held-out accuracy; odd rows."""

from itertools import product
from zlib import crc32

import numpy as np
import pytest

from clickloom.llm import toxicity


@pytest.mark.parametrize("seed", range(6))
def test_marginals_by_enumeration(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    model = toxicity.Field(moves=rng.normal(size=(2, 2)))
    counts = [4, 1, 6, 3]
    scores = rng.normal(scale=2, size=sum(counts))
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *counts[:-1]])] = True
    got = model.marginals(scores, first)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        total, wanted = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=n):
            weight = np.exp(sum(s for s, t in zip(own, tags) if t) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            wanted += weight * np.array(tags)
        assert got[at : at + n] == pytest.approx(wanted / total)
        at += n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.scored(frame, toxicity.learned(frame, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in scored.select("row.doc_id", "score", "spans", "row.text").collect() if r.doc_id in truth]
    held = [r for r in rows if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert 20 < len(held) < len(rows) / 3
    right = sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held)
    assert right >= 0.92 * len(held)  # the small table has 45 toxic training rows in four languages
    for r in rows:
        for s in r.spans:
            assert r.text[s.start : s.stop].isalpha()


def test_labels_held_out_are_not_seen(spark, docs):
    ids = [i for i in range(1, 400)]
    texts = [(i, "you idiot fool today" if i % 2 else "good morning to all") for i in ids]
    frame = docs(*texts)
    rows = [(i, i % 2 if crc32(str(i).encode()) % 5 else 1 - i % 2) for i in ids]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    for r in toxicity.scored(frame, toxicity.learned(frame, labels)).collect():
        assert (r.score >= 0.5) == bool(r.row.doc_id % 2)


def test_scores_do_not_move_with_the_number_of_labels(spark, docs):
    """Eight times the labels at the same share, with a limit that cuts toxic rows only then."""
    rng = np.random.default_rng(5)
    kinds = (("good", "fine", "idiot"), ("idiot", "fool", "good"))
    few, many = (
        [(i, " ".join(rng.choice(kinds[i % 10 == 0], 3)), int(i % 10 == 0)) for i in range(n)] for n in (600, 4800)
    )
    asked = docs("good fine good", "idiot good fine", "idiot good good", "fool idiot idiot", "idiot idiot good")
    found = []
    for rows in (few, many):
        frame = docs(*[r[:2] for r in rows])
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        _, ys, weight = toxicity.training_sample(frame, labels, 60)
        share = sum(ys) / (sum(ys) + weight * (len(ys) - sum(ys)))
        assert share == pytest.approx(0.1, abs=0.02)
        model = toxicity.learned(frame, labels, 60)
        found.append({r.row.doc_id: r.score for r in toxicity.scored(asked, model).collect()})
    assert {k: v >= 0.5 for k, v in found[0].items()} == {k: v >= 0.5 for k, v in found[1].items()}


def test_odd_rows(spark, docs, small_batches):
    texts = [None, "", "123 !!", "İstanbul idiot", "idiot", "idiot", "word " * 3000]
    frame = docs(*texts, (None, "idiot"), extra="score long, spans long")
    labels = spark.createDataFrame(
        [(4, 1), (5, 1), (7, 0), (None, 1), (3, None), (99, 1), (5, 1)], "doc_id long, toxic int"
    )
    model = toxicity.learned(frame, labels)
    rows = toxicity.scored(frame, model).collect()
    assert len(rows) == len(texts) + 1
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.row.text == "idiot"}) == 1
    nothing = toxicity.learned(docs(), labels)
    assert toxicity.scored(docs(), nothing).collect() == []
    assert toxicity.scored(frame, nothing).count() == len(texts) + 1
