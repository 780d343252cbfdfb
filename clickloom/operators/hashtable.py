"""Hash tables of words: collisions, slots, packed entries and probing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import hashing as H
from clickloom.operators.numbering import number_rows

HashFn = Callable[[Column], Column]
CHUNK = 1024


def collision_histogram(words: DataFrame, hash_fn: HashFn, bits: int) -> DataFrame:
    """Number of words per masked hash."""
    masked = H.low_bits(hash_fn(F.col("word")), bits)
    return words.groupBy(masked.alias("h")).agg(F.count(F.lit(1)).alias("n"))


def most_collided(histogram: DataFrame) -> DataFrame:
    """Every masked hash that reaches the highest count."""
    top = histogram.agg(F.max("n").alias("n"))  # one row
    return histogram.join(F.broadcast(top), "n", "left_semi").select("h", "n")


def entries(
    words: DataFrame, hash_fn: HashFn, low: int = 24, bits: int | None = None
) -> DataFrame:
    """``(bucket, idx, entry)`` of each word; buckets by ``bits`` bits, by default ``low``."""
    hashed = words.select("idx", hash_fn(F.col("word")).alias("_h"))
    return hashed.select(
        H.low_bits(F.col("_h"), bits or low).alias("bucket"),
        "idx",
        H.pack_entry(F.col("_h"), F.col("idx"), low).alias("entry"),
    )


def bucket_slots(
    table: DataFrame, cap: int | None = None, rows: int | None = None
) -> DataFrame:
    """Entries with their ordinal inside the bucket, optionally the first ``cap``."""
    slotted = number_rows(table, [F.col("idx")], within=["bucket"], name="slot", rows=rows)
    return slotted if cap is None else slotted.where(F.col("slot") < cap)


def build_hash_table(table: DataFrame, rows: int | None = None) -> DataFrame:
    """Entries of each bucket as arrays in index order.

    A bucket with more than ``CHUNK`` entries continues in further rows.
    """
    chunk = F.floor(F.col("slot") / CHUNK).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("slot", "entry")))
    return (
        bucket_slots(table, rows=rows)
        .groupBy("bucket", chunk.alias("chunk"))
        .agg(ordered.alias("_e"))
        .select("bucket", "chunk", F.col("_e.entry").alias("entries"))
    )


def probe(
    words: DataFrame, table: DataFrame, hash_fn: HashFn, low: int = 24
) -> DataFrame:
    """Vocabulary index of each word whose bucket holds its upper hash bits.

    Bucket and upper bits are joined on together, so a crowded bucket does not
    pair all its entries with all its probes.
    """
    hashed = words.select("word", hash_fn(F.col("word")).alias("_h"))
    wanted = hashed.select(
        "word",
        H.low_bits(F.col("_h"), low).alias("bucket"),
        H.upper_bits(F.col("_h"), low).alias("upper"),
    )
    stored = table.select("bucket", F.explode("entries").alias("entry")).select(
        "bucket",
        H.upper_bits(F.col("entry"), low).alias("upper"),
        H.low_bits(F.col("entry"), low).alias("found_idx"),
    )
    return wanted.join(stored, ["bucket", "upper"], "left").select(
        "word", "bucket", "found_idx"
    )
