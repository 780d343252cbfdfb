"""Toxic spans by a linear-chain conditional random field over words.

Labels belong to documents. Words that the toxic documents of the training sample have far more
often than the others are its labelled tokens; the field learns from them, over hashed word, prefix
and suffix features, to tag toxic words, also words it has never seen. Forward-backward marginals
give the spans, and a logistic curve over their sums gives the score of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import texts_of

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 1500  # training documents of each label at most
SAMPLE_CHARS = 32_768  # longest text that may be in the sample
HASH_BITS = 17
CACHED = 400_000
CHUNK = 512
SLICE_WORDS = 500_000
LIMIT = 25.0  # largest absolute emission score


def features(word: str) -> list[int]:
    """Hashed features of a word, whatever its case."""
    w = word.lower()
    named = (f"w {w}", f"p {w[:4]}", f"q {w[:5]}", f"s {w[-3:]}")
    return [crc32(n.encode()) >> (32 - HASH_BITS) for n in named]


def chain(gain: np.ndarray, fresh: np.ndarray, start: float, a, b, c, d) -> np.ndarray:
    """``o[t] = gain[t] * (a + b o[t-1]) / (c + d o[t-1])``, or ``gain[t] * start`` where ``fresh``.

    The stream is cut into chunks that advance together. A first pass composes each chunk's
    fractional linear maps to find what enters it; a second one computes the values.
    """
    n = len(gain)
    length = max(1, min(CHUNK, int(math.sqrt(n)) + 1))
    chunks = -(-n // length)
    pad = chunks * length - n
    # One row per step, so that a step reads neighbouring numbers.
    g = np.append(gain, np.ones(pad)).reshape(chunks, length).T.copy()
    f = np.append(fresh, np.zeros(pad, bool)).reshape(chunks, length).T.copy()
    top0, top1 = np.where(f, start, a) * g, np.where(f, 0.0, b) * g
    low0, low1 = np.where(f, 1.0, c), np.where(f, 0.0, d)
    p, q, r, s = np.ones(chunks), np.zeros(chunks), np.zeros(chunks), np.ones(chunks)
    for t in range(length):
        x0, x1, y0, y1 = top0[t], top1[t], low0[t], low1[t]
        p, q, r, s = x1 * p + x0 * r, x1 * q + x0 * s, y1 * p + y0 * r, y1 * q + y0 * s
        size = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / size, q / size, r / size, s / size
    entering = np.empty(chunks)
    value = 1.0
    for k in range(chunks):
        entering[k] = value
        value = (p[k] * value + q[k]) / (r[k] * value + s[k])
    out = np.empty((length, chunks))
    for t in range(length):
        entering = (top0[t] + top1[t] * entering) / (low0[t] + low1[t] * entering)
        out[t] = entering
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    """Weights of the field and of the curve over its marginals."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << HASH_BITS))
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 1.0, 0.0]))

    def emission(self, word: str) -> float:
        return float(np.clip(self.bias + self.weights[features(word)].sum(), -LIMIT, LIMIT))

    def passes(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, forward and backward odds of the words of texts that begin where ``first``."""
        gain = np.exp(scores)
        (m00, m01), (m10, m11) = np.exp(self.moves)
        forward = chain(gain, first, 1.0, m01, m11, m00, m10)
        last = np.append(first[1:], True)
        backward = chain(gain[::-1], last[::-1], 1.0, m10, m11, m00, m01)[::-1]
        return gain, forward, backward

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        gain, forward, backward = self.passes(scores, first)
        odds = forward * backward / gain
        return odds / (1 + odds)


def summed(marginals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, log of the expected toxic words, logit of the highest marginal, log of words."""
    sums, most = np.zeros(len(counts)), np.zeros(len(counts))
    full = counts > 0
    begin = (np.cumsum(counts) - counts)[full]
    if len(begin):
        sums[full] = np.add.reduceat(marginals, begin)
        most[full] = np.maximum.reduceat(marginals, begin)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack(
        [np.ones(len(counts)), np.log(sums + 1e-4), np.log(most / (1 - most)), np.log1p(counts)], 1
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def evidence(texts: list[list[str]], labels: np.ndarray) -> set[tuple[str, str]]:
    """Words and 4 and 5 letter prefixes that toxic texts have far more often than others.

    At least 2 % of the toxic texts have each, and three; its log odds are 4 or more.
    """

    def seen(w: str):
        return {("w", w), *((("p", w[:4]),) if len(w) > 3 else ()), *((("p", w[:5]),) if len(w) > 4 else ())}

    counts = Counter(), Counter()
    for words, label in zip(texts, labels, strict=True):
        counts[int(label)].update(set().union(*map(seen, set(words))) if words else ())
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    least = max(3, 0.02 * toxic)
    return {
        k for k, n in counts[1].items()
        if n >= least
        and math.log((n + 0.5) / (toxic + 1)) - math.log((counts[0][k] + 0.5) / (clean + 1)) >= 4
    }


def fit(texts: list[str], labels: list[int], weight: float = 1.0, steps: int = 25) -> Field:
    """The field that best explains the labelled words; ``weight`` is that of a clean text against a toxic one."""
    model = Field()
    y = np.array(labels, np.int64)
    words = [[w.lower() for w in WORD.findall(t)] for t in texts]
    if not y.any() or y.all():
        model.bias, model.curve = -LIMIT, np.array([4.0 if y.any() else -4.0, 0.0, 0.0, 0.0])
        return model
    known = evidence(words, y)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in words for w in t], np.int64)
    counts = np.array([len(t) for t in words])
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    listed = np.array([("w", w) in known or ("p", w[:4]) in known or ("p", w[:5]) in known for w in number], bool)
    truth = (listed[ids] & np.repeat(y > 0, counts)).astype(float) if len(ids) else np.zeros(0)
    table = np.array([features(w) for w in number], np.int64).reshape(-1, 4)

    squares = np.full(1 << HASH_BITS, 1e-2)
    more = np.full(5, 1e-2)
    pairs = ~first
    before = np.append(0.0, truth[:-1])
    observed = np.array(
        [[((1 - before) * (1 - truth))[pairs].sum(), ((1 - before) * truth)[pairs].sum()],
         [(before * (1 - truth))[pairs].sum(), (before * truth)[pairs].sum()]]
    )
    for _ in range(steps if len(ids) else 0):
        emission = np.clip(model.bias + model.weights[table].sum(axis=1), -LIMIT, LIMIT)
        gain, forward, backward = model.passes(emission[ids], first)
        odds = forward * backward / gain
        rest = truth - odds / (1 + odds)
        by_word = np.bincount(ids, rest, len(number))
        grad = np.bincount(table.reshape(-1), np.repeat(by_word, 4), 1 << HASH_BITS)
        grad -= 0.01 * model.weights
        squares += grad * grad
        model.weights += grad / np.sqrt(squares)
        o = np.append(1.0, forward[:-1])[pairs]
        x = backward[pairs]
        m = np.exp(model.moves)
        share = np.array([[m[0, 0] * np.ones_like(o), m[0, 1] * x], [m[1, 0] * o, m[1, 1] * o * x]])
        expected = (share / share.sum(axis=(0, 1))).sum(axis=2)
        whole = np.append((observed - expected).reshape(-1), rest.sum())
        more += whole * whole
        step = 0.5 * whole / np.sqrt(more)
        model.moves += step[:4].reshape(2, 2)
        model.moves = np.clip(model.moves, -8, 8)
        model.bias += step[4]

    emission = np.clip(model.bias + model.weights[table].sum(axis=1), -LIMIT, LIMIT)
    found = model.marginals(emission[ids], first) if len(ids) else np.zeros(0)
    x = summed(found, counts)
    importance = np.where(y > 0, 1.0, weight)
    curve = np.zeros(4)
    for _ in range(30):  # Newton steps of a logistic regression with a ridge
        p = sigmoid(x @ curve)
        bend = (x * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(4)
        curve = curve + np.clip(np.linalg.solve(bend, x.T @ (importance * (y - p)) - 0.5 * curve), -2, 2)
    model.curve = curve
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list, list, float]:
    """Texts and labels to fit on, and the weight of a clean text against a toxic one.

    The weight gives the sample the shares that the labels have in the whole table, so that scores
    do not move with its size. Of each label at most ``size`` rows that are not held out, in the
    order of a hash of the id. They are few, so they meet the documents in a broadcast join; the
    driver receives at most 2 * ``size`` texts of at most ``SAMPLE_CHARS`` characters.
    """
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(size)
    chosen = chosen.unionByName(known.where("toxic = 0").orderBy(*order).limit(size))
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    toxic = sum(r[2] for r in rows)
    weight = 1.0
    if 0 < toxic < len(rows):
        # Each label stands for all of its rows: a limit met by one of them must not move the other.
        weight = (total[0] / (len(rows) - toxic)) / (total[1] / toxic)
    return [r[1] for r in rows], [r[2] for r in rows], weight


def learned(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Field:
    return fit(*training_sample(docs, labels, size))


def scored(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` as struct ``row``, with ``score``, ``expected`` toxic words, and toxic ``spans``.

    Spans are of words with a marginal of one half or more, in code points, end exclusive. Null
    and empty texts have no words: they get the curve's score for that. Each text is scored alone,
    so repeated rows score alike. Nothing is shuffled.
    """
    cache: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

        def scores_of(words: list[str]) -> list[float]:
            try:
                return [cache[w] for w in words]
            except KeyError:
                if len(cache) > CACHED:
                    cache.clear()
                for w in words:
                    if w not in cache:
                        cache[w] = model.emission(w)
                return [cache[w] for w in words]

        def done(batch, at, found, counts):
            flat = np.array([s for t in found for s in t])
            n = np.array(counts)
            first = np.zeros(len(flat), bool)
            first[(np.cumsum(n) - n)[n > 0]] = True
            marginals = model.marginals(flat, first) if len(flat) else flat
            x = summed(marginals, n)
            spans = []
            ends = np.append(0, np.cumsum(n))
            toxic = np.append(0, np.cumsum(marginals >= 0.5))
            for i, row in enumerate(range(at, at + len(n))):
                if toxic[ends[i + 1]] == toxic[ends[i]]:
                    spans.append([])
                    continue
                own = marginals[ends[i] : ends[i + 1]] >= 0.5
                places = [m.span() for m in WORD.finditer(texts[row])]
                spans.append([{"start": places[k][0], "stop": places[k][1]} for k in np.flatnonzero(own)])
            sums = [float(marginals[ends[i] : ends[i + 1]].sum()) for i in range(len(n))]
            return pa.record_batch(
                [batch.column(0).slice(at, len(n)), pa.array(sigmoid(x @ model.curve)), pa.array(sums), pa.array(spans, span)],
                ["row", "score", "expected", "spans"],
            )

        for batch, texts in texts_of(batches):
            at, found, counts, held = 0, [], [], 0
            for text in texts:
                found.append(scores_of(WORD.findall(text)) if text else [])
                counts.append(len(found[-1]))
                held += counts[-1]
                if held >= SLICE_WORDS:
                    yield done(batch, at, found, counts)
                    at, found, counts, held = at + len(counts), [], [], 0
            if counts:
                yield done(batch, at, found, counts)

    framed = docs.select(F.struct("*").alias("row"), F.col("text"))
    added = T.StructType.fromDDL(
        "score double, expected double, spans array<struct<start:int,stop:int>>"
    )
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))
