"""Repetition rules: how much of a text lies in n-grams and lines that it repeats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import mixed, texts_of, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters that may lie in repetition.

    ``repeated``: by n-gram length, in n-grams that occur twice or more (the first included);
    ``lines``: in lines equal to an earlier line; ``symbols``: symbols per word.
    """

    repeated: dict[int, float] = field(
        default_factory=lambda: {5: 0.35, 6: 0.33, 7: 0.31, 8: 0.29, 9: 0.27, 10: 0.25}
    )
    lines: float = 0.30
    symbols: float = 0.10


def covered(ids: np.ndarray, weights: np.ndarray, sizes) -> dict[int, int]:
    """For each n: the weight of the words inside n-grams found twice or more.

    ``ids`` numbers the distinct words; n-grams are compared by a 64-bit rolling hash.
    """
    found, hashes = {}, np.zeros(len(ids), np.uint64)
    letters = mixed(ids.astype(np.uint64) + np.uint64(1))
    for n in range(1, max(sizes) + 1):
        windows = len(ids) - n + 1
        if windows < 2:
            found.update({m: 0 for m in sizes if m >= n})
            break
        hashes = hashes[:windows] * MULTIPLIER + letters[n - 1 :]
        if n not in sizes:
            continue
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            found.update({m: 0 for m in sizes if m >= n})
            break  # a longer n-gram repeats only where this one does
        twice = np.zeros(windows, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edges = np.zeros(len(ids) + 1, np.int64)
        edges[:windows] += twice
        edges[n:] -= twice
        found[n] = int(weights[np.cumsum(edges[:-1]) > 0].sum())
    return found


def measure(text: str | None, limits: Limits) -> tuple:
    """The measures of one text; a null text has no words."""
    tokens = words(text)
    if not tokens:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, True, False, 0.0, 0.0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, len(tokens))
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    if text.isascii():
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    else:
        lengths = np.fromiter((len(w.decode()) for w in tokens), np.int64, len(tokens))

    seen: set[str] = set()
    again = again_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                again += 1
                again_chars += len(line) - sum(map(line.count, SPACES))
            elif line.strip(SPACES):
                seen.add(line)

    repeated = covered(ids, np.ones(len(ids), np.int64), (3,))[3]
    most = 0.0
    fails = again_chars > limits.lines * chars or symbols > limits.symbols * len(tokens)
    if repeated:
        for n, c in covered(ids, lengths, tuple(limits.repeated)).items():
            most = max(most, c / chars)
            fails |= c > limits.repeated[n] * chars
    base = len(tokens) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(tokens)
    return (
        len(tokens), chars, symbols, again, repeated,
        bool(base), not (base or fails), again_chars / chars, most,
    )


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, repeated_share double"
)
NAMES = tuple(part.split()[0] for part in MEASURES.split(", "))
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def measured(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``docs`` as one struct column ``row``, with the measures of its ``text`` in ``rules``.

    Null and empty texts have zero words and fail. Repeated rows are measured each. One task
    works on one batch of rows at a time; there is no shuffle.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            found = zip(*(measure(t, limits) for t in texts), strict=True)
            rules = [pa.array(v, k) for v, k in zip(found, _KINDS, strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.StructArray.from_arrays(rules, list(NAMES))],
                ["row", "rules"],
            )

    framed = docs.select(F.struct("*").alias("row"), F.col("text"))
    rules = T.StructField("rules", T.StructType.fromDDL(MEASURES))
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], rules]))


def rejected_dropped(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    return measured(docs, limits).where("rules.kept").select("row.*")
