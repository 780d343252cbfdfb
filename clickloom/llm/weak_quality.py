"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or abstains. How often each pattern of votes occurs is all that
expectation-maximisation needs: a table of at most 3^9 rows, counted over all documents. It gives
every labeller's accuracy and every pattern's posterior. The posteriors are the soft labels that a
linear scorer over hashed features learns from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import keep, texts_of

BAD, GOOD, ABSTAIN = range(3)
SAMPLE = 8000  # documents that the scorer learns from at most
HASH_BITS = 16
CACHED = 300_000

_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~=]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PLAIN = re.compile(r"[^\W_]+[.,;:!?]?")


def _between(value: float, good, bad) -> int:
    """Good inside ``good``, bad outside ``bad``, otherwise no vote."""
    if good[0] <= value <= good[1]:
        return GOOD
    return ABSTAIN if bad[0] <= value <= bad[1] else BAD


#: name, measure, range of good values, range outside of which values are bad
LABELLERS = (
    ("words", "words", (50, 1e12), (20, 1e12)),
    ("symbols", "symbols", (0, 0.02), (0, 0.15)),
    ("capitals", "capitals", (0, 0.15), (0, 0.5)),
    ("letters", "letters", (0.85, 1), (0.75, 1)),
    ("distinct", "distinct", (0.6, 1e12), (0.4, 1e12)),
    ("most frequent word", "top", (0, 0.15), (0, 0.3)),
    ("plain words", "plain", (0.95, 1), (0.7, 1)),
    ("repeated lines", "lines", (0, 0), (0, 0.3)),
    ("neighbours alike", "alike", (0, 0.02), (0, 0.2)),
)


class Tokens:
    """Numbers the tokens of this process, with what the measures need to know of each."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.known = np.zeros((1 << 12, 6), np.int64)
        self.endings = {e: token_feature(f"a{e}") for e in ("", *".,;:!?")}

    def _facts(self, t: str) -> tuple:
        """Hashed shape, length, letters, capitals, symbols, whether the token is plain."""
        n = len(t)
        if t.isalpha() and t.islower():
            return self.endings[""], n, n, 0, 0, 1
        if t[-1] in ".,;:!?" and t[:-1].isalpha() and t.islower():
            return self.endings[t[-1]], n, n - 1, 0, 0, 1
        return (
            token_feature(t), n, sum(map(str.isalpha, t)), len(_CAPITAL.findall(t)),
            len(_SYMBOLS.findall(t)), _PLAIN.fullmatch(t) is not None,
        )

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number and facts of each token."""
        number = self.number
        if len(number) > CACHED:
            number.clear()
        try:
            ids = [number[t] for t in tokens]
        except KeyError:
            new = [t for t in dict.fromkeys(tokens) if t not in number]
            at = len(number)
            while at + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[at : at + len(new)] = [self._facts(t) for t in new]
            number.update(zip(new, range(at, at + len(new)), strict=True))
            ids = [number[t] for t in tokens]
        ids = np.array(ids, np.int64)
        return ids, self.known[ids]


def measures(text: str, ids: np.ndarray, facts: np.ndarray) -> dict[str, float]:
    """The measures of a text whose tokens have numbers ``ids`` and ``facts``."""
    n = max(1, len(ids))
    counts = np.unique(ids, return_counts=True)[1]
    _, length, letters, capitals, symbols, plain = facts.sum(axis=0).tolist()
    lines = [x for x in text.split("\n") if x.strip()] if "\n" in text else []
    pairs = len(np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:])) if len(ids) > 1 else 0
    return {
        "words": len(ids),
        "symbols": symbols / n,
        "capitals": capitals / max(1, length),
        "letters": letters / max(1, length),
        "plain": plain / n,
        # Long texts repeat words by nature: Herdan's law with exponent 0.9 as the measure.
        "distinct": len(counts) / n**0.9,
        "top": int(counts.max(initial=0)) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "alike": 1 - pairs / (n - 1) if n > 1 else 0.0,
    }


def votes(found: dict[str, float]) -> list[int]:
    return [_between(found[m], good, bad) for _, m, good, bad in LABELLERS]


def code(ballot: list[int]) -> int:
    """The pattern as one number in base 3."""
    return sum(v * 3**i for i, v in enumerate(ballot))


@dataclass
class Labels:
    """What expectation-maximisation found."""

    accuracy: np.ndarray  # [labeller, class, vote]
    prior: float
    posterior: np.ndarray  # of good, by pattern code


def aggregate(counts: dict[int, int], rounds: int = 100) -> Labels:
    """Votes are independent given the class; it starts from the number of bad votes."""
    n = len(LABELLERS)
    codes = np.arange(3**n)
    ballots = codes[:, None] // 3 ** np.arange(n) % 3
    weight = np.zeros(len(codes))
    for k, c in counts.items():
        weight[k] = c
    bad = (ballots == BAD).sum(1)
    posterior = 1.9 / (1 + 4.0**bad)  # the first guess: each bad vote counts four to one
    accuracy, prior = np.zeros((n, 2, 3)), 0.5
    for _ in range(rounds):
        for i in range(n):
            for v in range(3):
                own = ballots[:, i] == v
                accuracy[i, 1, v] = (weight * posterior)[own].sum() + 1
                accuracy[i, 0, v] = (weight * (1 - posterior))[own].sum() + (3 if v == BAD else 1)
        accuracy /= accuracy.sum(axis=2, keepdims=True)
        prior = ((weight * posterior).sum() + 1) / (weight.sum() + 2)
        logs = [
            np.log(p) + np.log(accuracy[np.arange(n), c])[np.arange(n), ballots].sum(1)
            for c, p in ((0, 1 - prior), (1, prior))
        ]
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -35, 35)))
        if np.abs(posterior - before)[weight > 0].max(initial=0) < 1e-9:
            break
    return Labels(accuracy, float(prior), posterior)


def token_feature(token: str) -> int:
    """A token's shape: letters, capitals, digits and punctuation, runs of one kind shortened."""
    shape = re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", token)
    shape = re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"[0-9]+", "9", shape))
    return crc32(shape.encode()) >> (32 - HASH_BITS)


def text_features(found: dict[str, float]) -> list[int]:
    """Hashed measures of the whole text, each in one of a few steps."""
    steps = [f"{name} {min(15, int(10 * found[name]))}" for name in ("symbols", "capitals", "letters", "plain", "distinct", "top", "lines", "alike")]
    steps.append(f"words {len(bin(int(found['words'])))}")
    return [crc32(s.encode()) >> (32 - HASH_BITS) for s in steps]


class Featurer:
    """Votes and sparse features: shares of token shapes, and steps of measures with weight 1."""

    def __init__(self):
        self.tokens = Tokens()

    def __call__(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        text = text or ""
        ids, facts = self.tokens(text.split())
        found = measures(text, ids, facts)
        index, n = np.unique(facts[:, 0], return_counts=True)
        index = np.concatenate([index, text_features(found)])
        value = np.concatenate([n / max(1, len(ids)), np.ones(len(index) - len(n))])
        return votes(found), index, value


def featured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text`` as struct ``row``, with the ``pattern`` of votes
    and features ``index`` and ``value``: one pass over the texts, kept.

    Null and empty texts count as texts without words. Every text is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurer = Featurer()
        for batch, texts in texts_of(batches):
            found = [featurer(t) for t in texts]
            ends = pa.array(np.cumsum([0, *(len(i) for _, i, _ in found)]), pa.int32())
            index = np.concatenate([i for _, i, _ in found]).astype(np.int32)
            value = np.concatenate([v for _, _, v in found])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([code(v) for v, _, _ in found], pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(index)),
                    pa.ListArray.from_arrays(ends, pa.array(value)),
                ],
                ["row", "pattern", "index", "value"],
            )

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    framed = docs.select(F.struct(*others).alias("row"), F.col("text"))
    added = T.StructType.fromDDL("pattern int, index array<int>, value array<double>")
    found = framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))
    return keep(found, "quality-features")


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float


def fit(rows: list[tuple], labels: Labels, steps: int = 120) -> Scorer:
    """Logistic regression on the posteriors of (pattern, index, value) rows."""
    weights = np.zeros(1 << HASH_BITS)
    if not rows:
        return Scorer(weights, float(np.log(labels.prior / (1 - labels.prior))))
    r = np.repeat(np.arange(len(rows)), [len(x[1]) for x in rows])
    x = np.concatenate([np.array(x[1], np.int64) for x in rows])
    v = np.concatenate([np.array(x[2]) for x in rows])
    y = labels.posterior[[x[0] for x in rows]]
    bias, squares, square = 0.0, np.full(len(weights), 1e-3), 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights[x] * v, len(y)), -35, 35)))
        rest = (y - p) / len(y)
        grad = np.bincount(x, rest[r] * v, len(weights)) - 1e-5 * weights
        squares += grad * grad
        weights += 0.5 * grad / np.sqrt(squares)
        square += rest.sum() ** 2
        bias += 0.5 * rest.sum() / np.sqrt(square)
    return Scorer(weights, float(bias))


def learned(found: DataFrame, size: int = SAMPLE) -> tuple[Labels, Scorer]:
    """Labels from the votes of all ``featured`` documents, and a scorer from a sample of them.

    The sample is the first ``size`` unlike documents in the order of a hash of their votes and
    features, so it does not depend on how rows are stored or split; copies count once. Tasks drop
    copies before anything moves. Only the sample comes to the driver, besides the pattern counts.
    """
    counted = {r[0]: r[1] for r in found.groupBy("pattern").count().collect()}
    labels = aggregate(counted)
    content = F.xxhash64(F.lit("sample"), "pattern", "index", "value").alias("content")
    hashes = found.select(content)
    chosen = hashes.distinct().orderBy("content").limit(size)
    rows = (
        found.select(content, F.struct("pattern", "index", "value").alias("held"))
        .join(F.broadcast(chosen), "content")
        .groupBy("content")
        .agg(F.min("held").alias("held"))
        .collect()
    )
    rows.sort(key=lambda r: r[0])
    return labels, fit([tuple(r[1]) for r in rows], labels)


def scored(found: DataFrame, labels: Labels, scorer: Scorer) -> DataFrame:
    """``featured`` documents as struct ``row``, with ``pattern``, ``posterior``, ``score``, ``kept``.

    Kept is a score of one half or more. Repeated rows score alike; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern = batch.column(1).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            x = batch.column(2).flatten().to_numpy()
            v = batch.column(3).flatten().to_numpy()
            r = np.repeat(np.arange(batch.num_rows), sizes)
            total = scorer.bias + np.bincount(r, scorer.weights[x] * v, batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(labels.posterior[pattern]), pa.array(score), pa.array(score >= 0.5)],
                ["row", "pattern", "posterior", "score", "kept"],
            )

    framed = found.select("row", "pattern", "index", "value")
    added = T.StructType.fromDDL("pattern int, posterior double, score double, kept boolean")
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))
