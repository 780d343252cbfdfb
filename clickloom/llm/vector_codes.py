"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

All arithmetic is in integers. Parts and entries are padded with zeros to a power of two and go
through a Walsh-Hadamard transform, which scales every squared distance by the padded length. The
squared differences add up coefficient by coefficient, from few sign changes to many: smooth parts
tell most in the first ones, and an entry whose sum passes that of a full candidate is dropped.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import keep

SCALE = 256
PARTS = 16
ENTRIES = 64  # of one codebook; an index must fit two hexadecimal digits
ROUNDS = 2
HOT_GROUPS = 4096  # groups that may each hold this share of all rows: as many can be broadcast


@functools.cache
def sequency(length: int) -> np.ndarray:
    """Positions of the transform's coefficients in order of their sign changes."""
    rows = np.eye(length, dtype=np.int64)
    changes = (np.diff(_butterflies(rows), axis=1) != 0).sum(axis=1)
    return np.argsort(changes, kind="stable")


def _butterflies(rows: np.ndarray) -> np.ndarray:
    length, half = rows.shape[1], 1
    while half < length:
        pairs = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        rows = rows.reshape(len(rows), length)
        half *= 2
    return rows


def walsh(parts: np.ndarray) -> np.ndarray:
    """Transform of each row of integers, zero-padded to a power of two, in sequency order."""
    length = 1 << max(parts.shape[1] - 1, 0).bit_length()
    padded = np.zeros((len(parts), length), np.int64)
    padded[:, : parts.shape[1]] = parts
    return _butterflies(padded)[:, sequency(length)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, ties to the lower one, and the squared distance.

    Both are transformed. The bound is the full distance of the entry that is best by the first
    coefficient; no entry is dropped at the bound itself, so ties are all compared.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = points.shape[1]
    sums = (points[:, :1] - entries[None, :, 0]) ** 2
    bound = ((points - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    rows, cols = np.nonzero(sums <= bound[:, None])
    sums = sums[rows, cols]
    for c in range(1, length):
        sums = sums + (points[rows, c] - entries[cols, c]) ** 2
        left = sums <= bound[rows]
        rows, cols, sums = rows[left], cols[left], sums[left]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    best = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == best[rows])
    hits = hits[np.diff(rows[hits], prepend=-1) != 0]
    return cols[hits], best // length


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """One row of ``dim`` integers per list, shorter lists filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    table = np.zeros((len(sizes), dim), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    table[rows, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return table


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null, infinite or undefined components."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    return F.coalesce(finite, F.lit(False))


def integers(vectors: DataFrame, vector: str) -> DataFrame:
    """Usable rows as ``row``, the columns but ``vector``, and ``x``: components times 256, floored."""
    carried = [F.col(f"`{c}`") for c in vectors.columns if c != vector]
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(usable(F.col(vector))).select(F.struct(*carried).alias("row"), scaled.alias("x"))


def _assigned(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = books.shape[2]
    for p, book in enumerate(books):
        yield nearest(walsh(x[:, p * width : (p + 1) * width]), walsh(book))


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of their parts; unused entries stay.

    Each task adds up its parts by entry; the driver receives one row per used entry.
    """
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(books.shape, np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            for p, (codes, _) in enumerate(_assigned(x, books)):
                np.add.at(sums[p], codes, x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes, minlength=entries)
        own = np.flatnonzero(counts)
        columns = [own, counts.reshape(-1)[own], *sums.reshape(-1, width)[own].T]
        yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["slot", "n", *names])

    schema = ", ".join(f"{n} long" for n in ("slot", "n", *names))
    added = rows.select("x").mapInArrow(run, schema).groupBy("slot").agg(
        F.sum(F.col("n")).alias("n"), *[F.sum(s).alias(s) for s in names]
    )
    out = books.reshape(-1, width).copy()
    for slot, n, *sums in added.collect():
        out[slot] = [s // n for s in sums]
    return out.reshape(books.shape)


def with_codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``row`` with its ``code``, two hexadecimal digits a part, and the summed squared ``error``."""
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), parts * width)
            found = list(_assigned(x, books))
            codes = digits[np.stack([c for c, _ in found], axis=1)]
            error = np.sum([d for _, d in found], axis=0)
            text = pa.array(["".join(c) for c in codes], pa.string())
            yield pa.record_batch(
                [batch.column(0), text, pa.array(error, pa.int64())], ["row", "code", "error"]
            )

    rest = T.StructType.fromDDL("code string, error long").fields
    return rows.select("row", "x").mapInArrow(run, T.StructType([rows.schema["row"], *rest]))


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()


def group_errors(coded: DataFrame, group: str) -> DataFrame:
    """``coded`` with ``group_error``: the error summed over equal values of ``row.group``.

    Groups with at least a ``HOT_GROUPS``-th of all rows are at most that many and answered from a
    broadcast; the others are joined by group, where none is large.
    """
    key = F.col(f"row.`{group}`")
    sums = keep(
        coded.groupBy(key.alias("g")).agg(F.sum("error").alias("group_error"), F.count(F.lit(1)).alias("n")),
        "group-errors",
    )
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.col("n") * HOT_GROUPS >= total
    hot, rest = F.broadcast(sums.where(large).drop("n")), sums.where(~large).drop("n")
    same = key.eqNullSafe(F.col("g"))
    return coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(rest, same)).drop("g")


def compressed(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", group: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the final codebooks (part, entry, component).

    The result has ``row`` (the columns but the vector), ``code``, ``error`` and ``group_error``.
    Rows whose vector is null or holds null or non-finite components are left out. Codebooks start
    as the vectors of the smallest ids, equal ids in order of their components, null ids last; fewer
    rows make fewer entries. Null groups count as one. Vectors of unlike or indivisible length are
    filled up with zeros to the next multiple of ``parts`` of the longest. Components must be so
    small that a vector's distance fits 64 bits (below 370,000 at 64 components); a larger one fails
    the job. An empty table gives an empty result and no entries. Repeated rows are coded each.
    """
    rows = keep(integers(vectors, vector), "integers")
    dim, most = rows.agg(
        F.max(F.size("x")), F.max(F.greatest(F.array_max("x"), -F.array_min("x")))
    ).first()
    width = max(1, -(-(dim or 0) // parts))
    length = 1 << (width - 1).bit_length()
    if (most or 0) > math.isqrt((2**63 - 1) // (4 * parts * width * length)):
        raise ValueError(f"a component of {most / SCALE:g} is too large for 64-bit distances")
    first = rows.orderBy(F.col(f"row.`{vec_id}`").asc_nulls_last(), "x").limit(entries).collect()
    books = np.zeros((len(first), parts * width), np.int64)
    for book, r in zip(books, first, strict=True):
        book[: len(r["x"])] = r["x"]
    books = books.reshape(len(first), parts, width).transpose(1, 0, 2)
    if len(first):
        for _ in range(rounds):
            books = moved(rows, books)
    coded = keep(with_codes(rows, books), "codes")
    return group_errors(coded, group), books
