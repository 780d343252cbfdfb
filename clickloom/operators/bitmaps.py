"""Sorted vocabularies of bounded integers as bitmaps: the id of a value is the rank of its bit.

A bitmap row holds ``BITS`` neighbouring values of a column, as Spark's own bitmap functions lay them
out: ``(feature, bucket, bits)`` with buckets from 1. A vocabulary of all values below 2**29 is 64 MB
a column however many there are, merges by OR, and is applied without a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.rows import quoted
from clickloom.operators.vocabulary import COUNTED_ROWS, apply_vocabulary
from clickloom.session import store

BITS = 32_768
_BYTES = BITS // 8
# Bytes of all bitmaps sent to every task; beyond, the vocabulary is applied as rows.
BROADCAST_BYTES = 256 * 1024 * 1024


def value_bitmaps(df: DataFrame, features: Sequence[str], below: int) -> DataFrame:
    """Bitmaps of the values of integer columns, all from 0 to ``below - 1``; NULL is no value.

    Tasks drop the repeats of ``COUNTED_ROWS`` rows at a time first, so a value that most rows have
    crosses the shuffle a few times. Values then meet by bucket and become bits; a bucket is at most
    ``BITS`` values, of which each task sends one.
    """
    names = list(features)
    buckets = -(-below // BITS)

    def distinct(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        for code, column in enumerate(table.columns):
            values = np.unique(column.drop_null().cast(pa.int64()).to_numpy())
            if len(values) and (values[0] < 0 or values[-1] >= below):
                raise ValueError(f"{names[code]} has a value outside 0 to {below - 1}")
            slot = code * buckets + values // BITS
            yield pa.record_batch([pa.array(slot), pa.array(values % BITS)], ["slot", "position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= COUNTED_ROWS:
                yield from distinct(parts)
                parts, rows = [], 0
        if rows:
            yield from distinct(parts)

    found = df.select(*[quoted(f) for f in names]).mapInArrow(run, "slot long, position long")
    # By slot first: a partial bitmap for every few values of a task would be larger than they are.
    made = found.repartition("slot").groupBy("slot").agg(F.bitmap_construct_agg("position").alias("bits"))
    code = F.get(F.array(*[F.lit(f) for f in names]), F.floor(F.col("slot") / buckets).cast("int"))
    return made.select(code.alias("feature"), (F.pmod("slot", F.lit(buckets)) + 1).alias("bucket"), "bits")


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Bitmaps of the values that any of the parts has."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("feature", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """Number of distinct values per column."""
    return bitmaps.groupBy("feature").agg(F.sum(F.bitmap_count("bits")).alias("cardinality"))


def rank_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps with ``base``: how many values of their column lie in earlier buckets. Kept once.

    A column has at most its bound over ``BITS`` buckets (16,384 for 2**29), so a window is small.
    """
    kept = store(bitmaps, "bitmaps")
    sizes = kept.select("feature", "bucket", F.bitmap_count("bits").alias("n"))
    earlier = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("feature", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return kept.join(bases, ["feature", "bucket"])


def _bits(batch: pa.RecordBatch, column: int) -> np.ndarray:
    raw = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, _BYTES)


def vocabulary_of(ranked: DataFrame) -> DataFrame:
    """``(feature, value, idx)`` of every bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, position = np.nonzero(np.unpackbits(_bits(part, 2), axis=1, bitorder="little"))
                starts = np.searchsorted(row, np.arange(part.num_rows))
                bucket, base = part.column(1).to_numpy(), part.column(3).to_numpy()
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(row)),
                        pa.array((bucket[row] - 1) * BITS + position),
                        pa.array(base[row] + np.arange(len(row)) - starts[row]),
                    ],
                    ["feature", "value", "idx"],
                )

    ordered = ranked.select("feature", F.col("bucket").cast("long"), "bits", F.col("base").cast("long"))
    return ordered.mapInArrow(run, "feature string, value long, idx long")


class Ranks:
    """Bits of one column as words, with the number of bits before each word.

    Only the buckets that have a value are held, whatever the largest value is.
    """

    def __init__(self, buckets: np.ndarray, bits: np.ndarray):
        order = np.argsort(buckets)
        self.place = np.full(int(buckets.max(initial=0)), -1, np.int32)
        self.place[buckets[order] - 1] = np.arange(len(order))
        self.words = bits[order].view(np.uint64).reshape(-1)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def lookup(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of values, and which of them are there."""
        inside = (values >= 0) & (values < BITS * len(self.place))
        held = np.where(inside, values, 0)
        if not len(self.words):
            return held, inside
        place = self.place[held // BITS].astype(np.int64)
        inside &= place >= 0
        at = np.maximum(place, 0) * (BITS // 64) + (held % BITS >> 6)
        word = self.words[at]
        shift = (held & 63).astype(np.uint64)
        rank = self.before[at] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        return rank, inside & ((word >> shift) & np.uint64(1)).astype(bool)


def apply_bitmaps(
    df: DataFrame, features: Sequence[str], ranked: DataFrame, oov_id: int | None = None,
    row_key: str | None = None,
) -> DataFrame:
    """Replace values by ids in every feature column; unknown ones by ``oov_id`` (None: NULL).

    Bitmaps of up to ``BROADCAST_BYTES`` go to every task as they are, and no row is joined or moved.
    Larger ones are turned into rows and looked up by ``apply_vocabulary``.
    """
    wanted = ranked.where(F.col("feature").isin(list(features)))
    if wanted.count() * 2 * _BYTES > BROADCAST_BYTES:  # bits, and a count for each word of them
        unseen = "null" if oov_id is None else "oov"
        return apply_vocabulary(
            df, features, store(vocabulary_of(wanted), "vocabulary"), unseen, oov_id or 0, row_key
        )
    table = wanted.select("feature", "bucket", "bits").toArrow()
    ranks = {}
    for f in features:
        own = table.filter(pc.equal(table["feature"], f)).combine_chunks()
        rows = own.to_batches()
        bits = np.concatenate([_bits(b, 2) for b in rows]) if rows else np.zeros((0, _BYTES), np.uint8)
        ranks[f] = Ranks(own["bucket"].to_numpy().astype(np.int64), bits)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name, column in zip(names, batch.columns):
                if name in shared.value:
                    given = column.is_valid().to_numpy(zero_copy_only=False)
                    ids, known = shared.value[name].lookup(column.fill_null(0).cast(pa.int64()).to_numpy())
                    known &= given
                    column = pa.array(ids, mask=~known) if oov_id is None else pa.array(np.where(known, ids, oov_id))
                columns.append(column)
            yield pa.record_batch(columns, names)

    fields = [T.StructField(f.name, T.LongType()) if f.name in ranks else f for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))
