"""Splitting rows into contiguous blocks and shuffling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.draws import draw
from clickloom.functions.permute import permute
from clickloom.operators.numbering import block_of, number_rows, number_wide_rows, positions_in_files


def block_starts(rows: int, blocks: int) -> list[int]:
    """First positions of ``blocks`` blocks whose sizes differ by at most one."""
    size, extra = divmod(rows, blocks)
    return [b * size + min(b, extra) for b in range(blocks)]


def block_bounds(df: DataFrame, key: str, blocks: int) -> list:
    """First key of blocks 1, 2, ...: only the key column is sorted."""
    numbered = number_rows(df.select(key), [F.col(key)], name="_pos")
    rows = numbered.count()
    starts = [s for s in block_starts(rows, blocks)[1:] if s < rows]
    found = numbered.where(F.col("_pos").isin(starts)).orderBy("_pos")
    return [r[key] for r in found.collect()]  # at most ``blocks`` rows


def split_contiguous(
    df: DataFrame, key: str, blocks: int, name: str = "split"
) -> DataFrame:
    """Cut the rows, in order of a unique ``key``, into equal contiguous blocks.

    The first blocks take the remainder. The wide rows are not shuffled.
    """
    return df.withColumn(name, block_of(F.col(key), block_bounds(df, key, blocks)))


def train_val_test(
    df: DataFrame, split: str, key: str, last: int, name: str = "role"
) -> DataFrame:
    """Last split to test (first half, rounded up) and val; the others to train."""
    bounds = block_bounds(df.where(F.col(split) == last), key, 2)
    half = block_of(F.col(key), bounds)
    role = F.when(F.col(split) != last, "train").when(half == 0, "test").otherwise("val")
    return df.withColumn(name, role)


def rows_per_split(df: DataFrame, split: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def split_offsets(sizes: DataFrame, split: str = "split") -> DataFrame:
    """Rows before each split; ``sizes`` has one row per split."""
    before = Window.orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def shuffle_within_split(
    df: DataFrame,
    split: str,
    key: str,
    seed: int = 0,
    pinned: int | None = None,
    name: str = "slot",
    narrow: DataFrame | None = None,
) -> DataFrame:
    """New position of each row inside its split; ``pinned`` keeps key order.

    ``narrow``, split and integer key of the same rows, says that the rows are wide: they move once.
    """
    order = draw(seed, F.col(key))
    if pinned is not None:
        order = F.when(F.col(split) != pinned, order)
    drawn = df.withColumn("_draw", order)
    ordered = [F.col("_draw"), F.col(key)]
    if narrow is None:
        return number_rows(drawn, ordered, within=[split], name=name).drop("_draw")
    first = F.coalesce("_draw", key)  # a split has draws in all rows or in none
    keys = narrow.withColumn("_draw", order)
    return number_wide_rows(drawn, ordered, split, first, keys, name).drop("_draw")


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, name: str = "slot") -> DataFrame:
    """New position of each row in a random order of all rows."""
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    return number_rows(drawn, [F.col("_draw"), F.col(key)], name=name).drop("_draw")


def shuffle_into_splits(
    df: DataFrame, split: str, key: str, last: int | None = None, seed: int = 0,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Deal all rows at random to buckets as large as the original splits.

    Adds ``bucket`` and ``slot``. Cutting one random order of the rows at the
    split offsets fills every bucket exactly and is random inside each one.
    The ``last`` split, when given, keeps its rows in key order. ``narrow`` is as in
    ``shuffle_within_split``.
    """
    known = df if narrow is None else narrow
    open_sizes = rows_per_split(known.where(~F.col(split).eqNullSafe(F.lit(last))), split)
    offsets = split_offsets(open_sizes, split).orderBy(split)
    open_splits = [(r[split], r["offset"]) for r in offsets.collect()]  # one per split
    pin = F.col(split).eqNullSafe(F.lit(last)).cast("int")
    dealt = shuffle_within_split(
        df.withColumn("_pin", pin),
        "_pin",
        key,
        seed,
        pinned=1 if last is not None else None,
        name="_pos",
        narrow=None if narrow is None else narrow.withColumn("_pin", pin),
    )
    index = block_of(F.col("_pos"), [start for _, start in open_splits[1:]])
    ids = F.array(*[F.lit(s) for s, _ in open_splits])
    begins = F.array(*[F.lit(start) for _, start in open_splits])
    pinned = F.col("_pin") == 1
    return dealt.select(
        *df.columns,
        F.when(pinned, F.col(split)).otherwise(F.get(ids, index)).alias("bucket"),
        (F.col("_pos") - F.when(pinned, F.lit(0)).otherwise(F.get(begins, index))).alias(
            "slot"
        ),
    )


def shuffle_files(
    df: DataFrame, blocks: int, seed: int = 0, across: bool = False, last: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Contiguous ``split`` in file order, and a random ``bucket`` and ``slot``: no row is sorted or moved.

    ``df`` must come straight from ``spark.read.parquet``. A row's place in its file gives its place
    among all rows, that gives its block, and a permutation by formula gives its new place, inside
    the block or, with ``across``, among all blocks. Block ``last``, if given, keeps its order.
    """
    numbered = positions_in_files(df, "_pos")
    total = df.count() if rows is None else rows
    starts = block_starts(total, blocks)
    sizes = [b - a for a, b in zip(starts, [*starts[1:], total])]
    split = block_of(F.col("_pos"), starts[1:])
    begins, lengths = (F.array(*[F.lit(x).cast("bigint") for x in xs]) for xs in (starts, sizes))
    placed = numbered.withColumn("split", split)
    begin, length = F.get(begins, F.col("split")), F.get(lengths, F.col("split"))
    inside = F.col("_pos") - begin
    pinned = F.col("split").eqNullSafe(F.lit(last))
    if not across:
        slot = F.when(pinned, inside).otherwise(permute(inside, length, seed))
        return placed.select(*df.columns, "split", F.col("split").alias("bucket"), slot.alias("slot"))
    # The open blocks close up: places after the pinned one lie that much lower.
    gap_at, gap = (starts[last], sizes[last]) if last is not None else (total, 0)
    closed = F.col("_pos") - F.when(F.col("_pos") >= gap_at + gap, gap).otherwise(0)
    moved = placed.withColumn("_new", permute(closed, F.lit(total - gap).cast("bigint"), seed))
    opened = F.col("_new") + F.when(F.col("_new") >= gap_at, gap).otherwise(0)
    moved = moved.withColumn("_at", F.when(pinned, F.col("_pos")).otherwise(opened))
    bucket = block_of(F.col("_at"), starts[1:])
    moved = moved.withColumn("bucket", bucket)
    slot = (F.col("_at") - F.get(begins, F.col("bucket"))).alias("slot")
    return moved.select(*df.columns, "split", "bucket", slot)


def sample_fixed(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen uniformly."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
