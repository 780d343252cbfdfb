"""Importance resampling: draw documents so that their words are spread as in a target text.

Every word falls into one of ``BUCKETS`` hash buckets. A bucket's gain says how much commoner it is
in the target than in the documents; a document's weight adds up the gains of its words, and noise
fixed by its id turns the highest weights into a random draw. The draw's cutoff is found by bisection:
each job counts, over the stored scores, the rows up to a few cut points. No row is sorted for that.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import ROWS, keep
from clickloom.operators.numbering import number_rows

BUCKETS = 10_000
LONGEST = 1  # words of the longest run that is a feature
MIN_WORDS = 20  # of a document that may be drawn
PERCENT = 10
SEED = "2024"
CUTS = 15  # cut points that one count job tries: four halvings at once
CACHED = 200_000  # words whose bucket a task remembers

# Words are runs of digits, letters and whatever is not ASCII; A-Z count as a-z.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


class _Buckets(dict):
    """Bucket of a feature: the CRC-32 of its UTF-8 bytes modulo ``buckets``."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def features(text: bytes | None, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """Number of words of a text, and its runs of 1 to ``longest`` words, repeats included."""
    words = text.translate(_LETTERS).split() if text else []
    found = words
    for n in range(2, longest + 1):
        found = found + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), found


def hashed(texts: DataFrame, carried: Sequence[str], buckets: int, longest: int) -> DataFrame:
    """Columns ``carried`` as struct ``row``, with ``n_words`` and the ``buckets`` of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words, lists = [], []
                for text in part.column(1).to_pylist():
                    n, found = features(text, longest)
                    words.append(n)
                    lists.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                ends = np.cumsum([0, *map(len, lists)])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(words, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    ],
                    ["row", "n_words", "buckets"],
                )
            pa.default_memory_pool().release_unused()

    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    framed = texts.select(row.alias("row"), F.col("text").cast("binary"))
    rest = T.StructType.fromDDL("n_words long, buckets array<int>").fields
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *rest]))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows. Tasks count first; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    counted = found.select("buckets").mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, object)
    for bucket, n in counted.groupBy("bucket").agg(F.sum(F.col("n")).alias("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: Sequence[int], target: Sequence[int]) -> np.ndarray:
    """Per bucket: a thousand times the log ratio of its smoothed shares, rounded down."""
    buckets, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return np.array(
        [
            math.floor(
                1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))
            )
            for s, t in zip(map(float, source), map(float, target), strict=True)
        ],
        np.int64,
    )


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``row``, ``n_words``, ``n_features`` and ``weight``: the sum of the features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            columns = [*batch.columns[:2], pa.array(np.diff(ends)), pa.array(weight)]
            yield pa.record_batch(columns, ["row", "n_words", "n_features", "weight"])

    rest = T.StructType.fromDDL("n_words long, n_features long, weight long").fields
    return found.select("row", "n_words", "buckets").mapInArrow(
        run, T.StructType([found.schema["row"], *rest])
    )


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise fixed by seed and id, in thousandths, rounded down; a null id counts as no text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int, int]:
    """The least ``c`` for which at least ``wanted`` rows have ``key <= c``, by bisection.

    Also how many rows lie below it and how many on it. ``rows`` has at least ``wanted`` of them.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        cuts = sorted({low + (high - low) * i // (CUTS + 1) for i in range(1, CUTS + 1)})
        counts = rows.agg(*[F.count_if(key <= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        enough = next((i for i, n in enumerate(counts) if n >= wanted), len(cuts))
        low = cuts[enough - 1] + 1 if enough else low
        high = cuts[enough] if enough < len(cuts) else high
    below, at = rows.agg(F.count_if(key < F.lit(low)), F.count_if(key == F.lit(low))).first()
    return low, below, at


def first_rows(rows: DataFrame, keys: Sequence[Column], wanted: int) -> Column:
    """Condition for the first ``wanted`` rows in order of ``keys``, integers that are never null.

    Each key is bisected among the rows that tie on the ones before it. The last must have no ties.
    """
    if wanted <= 0:
        return F.lit(False)
    chosen, tied = F.lit(False), F.lit(True)
    for key in keys:
        c, below, at = cutoff(rows.where(tied), key, wanted)
        chosen = chosen | (tied & (key < F.lit(c)))
        tied = tied & (key == F.lit(c))
        wanted -= below
        if wanted == at:
            break
    return chosen | tied


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: str = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """Every row of ``docs`` with ``n_features``, ``weight``, ``score`` and its ``rank`` in the draw.

    ``row`` has the columns of ``docs`` but ``text``; ``target`` needs only ``text``. Of the N rows
    with at least ``min_words`` words, ``percent * N // 100`` of the highest scores are drawn, ties to
    the smaller ``doc_id``, null ids last; rows alike in both are drawn in any order. ``rank`` counts
    the drawn rows from 1 and is null for the others. Null and empty texts have no features and weight
    0, and an empty ``docs`` or ``target`` is no special case: gains are smoothed. Texts are read
    whole; a repeated row is scored and drawn as each of its copies.
    """
    carried = [c for c in docs.columns if c != "text"]
    wanted = bucket_counts(hashed(target, [], buckets, longest), buckets)
    found = keep(hashed(docs, carried, buckets, longest), "features")
    gain = gains(bucket_counts(found, buckets), wanted)
    score = (F.col("weight") + noise(F.col("row.doc_id"), seed)).alias("score")
    rows = keep(
        weighted(found, gain).select(
            "row", "n_words", "n_features", "weight", score, F.monotonically_increasing_id().alias("uid")
        ),
        "scores",
    )
    able = rows.where(F.col("n_words") >= min_words)
    doc_id = F.col("row.doc_id")
    keys = [-F.col("score"), doc_id.isNull().cast("long"), F.coalesce(doc_id, F.lit(0)), F.col("uid")]
    drawn = (F.col("n_words") >= min_words) & first_rows(able, keys, percent * able.count() // 100)
    ranked = number_rows(rows.where(drawn), keys, name="rank", start=1)
    others = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("row", "n_words", "n_features", "weight", "score", "rank")
