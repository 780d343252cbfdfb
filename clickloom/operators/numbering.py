"""Consecutive row numbers at any size.

A window without a partition, or with a few large ones, sorts a whole group in
one task. Here the rows are range-partitioned by (group, order) instead, so one
group may span many tasks, and each task's start is added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import shuffle_parts, store

# A table this small may be numbered by one window: a single task can hold it.
PLAIN_ROWS = 500_000
# Rows of one range, beyond the ranges that the session's shuffle partitions make.
RANGE_ROWS = 1_000_000
# Rows that one task sorts when wide rows are numbered.
BLOCK_ROWS = 250_000
# Files whose starts are broadcast.
BROADCAST_FILES = 1_000_000
_TASK_BITS = 33  # monotonically_increasing_id keeps the task in the bits above


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "pos",
    start: int = 0,
    rows: int | None = None,
    lead: Column | None = None,
    plain_rows: int = PLAIN_ROWS,
) -> DataFrame:
    """Number rows from ``start`` in ``order_by`` order, anew per ``within`` group.

    ``order_by`` must order the rows of a group without ties. ``rows`` is the
    row count when the caller knows it; only then may the plain window be used, up to ``plain_rows``,
    and only then do the ranges grow in number with the rows.
    ``lead`` may give a BIGINT that never decreases in (group, order): Spark
    compares one number about three times faster than a group and its order.
    """
    groups = list(within)
    if rows is not None and rows <= plain_rows:
        window = Window.partitionBy(*groups).orderBy(*order_by)
        number = F.row_number().over(window).cast("bigint") + (start - 1)
        return df.withColumn(name, number)

    order = [*[F.col(g) for g in groups], *order_by]
    if lead is not None:
        order = [lead, *order]
    wanted = -(-(rows or 0) // RANGE_ROWS)
    more = [wanted] if wanted > shuffle_parts(df.sparkSession) else []
    sequenced = store(
        df.repartitionByRange(*more, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_task", F.shiftright("_seq", _TASK_BITS))

    # At most one row per task and one per group.
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("_task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = sequenced.groupBy("_task", *groups).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    starts = store(
        pieces.select(
            F.col("_task").alias("_s_task"),
            *[F.col(g).alias(f"_s_{g}") for g in groups],
            (
                F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
            ).alias("_shift"),
        ),
        "starts",
    )
    same = [F.col("_task") == F.col("_s_task")]
    same += [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in groups]
    # No hint: the stored file sizes let Spark broadcast ``starts`` if it is small.
    return sequenced.join(starts, reduce(Column.__and__, same)).select(
        *df.columns, (F.col("_seq") + F.col("_shift") + start).alias(name)
    )


def block_of(value: Column, bounds: Sequence, low: int = 0) -> Column:
    """Index of the block that holds ``value``: a search tree of comparisons.

    ``bounds`` are the ascending first values of blocks 1, 2, ...
    """
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(
        value < F.lit(bounds[middle]), block_of(value, bounds[:middle], low)
    ).otherwise(block_of(value, bounds[middle + 1 :], low + middle + 1))


def _block_of_group(group: Column, key: Column, blocks: Sequence[tuple]) -> Column:
    """Block of a row from ``(group, bounds, first block)`` by group: a search tree of search trees."""
    if len(blocks) == 1:
        return block_of(key, *blocks[0][1:])
    if blocks[0][0] is None:
        return F.when(group.isNull(), block_of(key, *blocks[0][1:])).otherwise(
            _block_of_group(group, key, blocks[1:])
        )
    middle = len(blocks) // 2
    return F.when(group < F.lit(blocks[middle][0]), _block_of_group(group, key, blocks[:middle])).otherwise(
        _block_of_group(group, key, blocks[middle:])
    )


def number_wide_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    within: str,
    key: Column,
    narrow: DataFrame,
    name: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``number_rows`` for wide rows: each moves once, straight to the task that sorts its block.

    ``narrow`` has the columns that ``order_by``, ``within`` and ``key`` use, of the same rows. ``key``
    is an integer that never decreases in ``order_by`` inside a group. Approximate quantiles of it cut
    each group into blocks of about ``block_rows`` rows, fewer if cores would idle; these are counted, so a row's number is its
    block's start and its place there. Any bounds give the same numbers.
    """
    total = narrow.count()
    if not total:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    block_rows = min(block_rows, -(-total // cores))
    shares = -(-total // block_rows)
    cuts = F.array(*[F.lit(i / shares) for i in range(1, shares)] or [F.lit(0.5)])
    found = narrow.groupBy(within).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(key, cuts, 10_000).alias("cuts")
    )
    blocks, first = [], 0
    # One row per group, with as many bounds as there are blocks.
    for r in sorted(found.collect(), key=lambda r: (r[within] is not None, r[within])):
        wanted = min(-(-r["n"] // block_rows), shares)
        bounds = sorted({r["cuts"][i * shares // wanted - 1] for i in range(1, wanted)})
        blocks.append((r[within], bounds, first))
        first += len(bounds) + 1
    block = _block_of_group(F.col(within), key, blocks)
    sizes = {r["_block"]: r["count"] for r in narrow.groupBy(block.alias("_block")).count().collect()}
    starts = []
    for _, bounds, low in blocks:
        at = 0
        for b in range(low, low + len(bounds) + 1):
            starts.append(at)
            at += sizes.get(b, 0)
    # Partition and block have the same number, so a row's place in its partition is its place in the block.
    sequenced = (
        df.withColumn("_block", block)
        .repartitionById(first, F.col("_block"))
        .sortWithinPartitions(within, *order_by)
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _TASK_BITS) - 1)))
    )
    start = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_block"))
    return sequenced.select(*df.columns, (start + F.col("_seq")).alias(name))


def lead_of(code: Column, codes: int, key: Column) -> Column:
    """``lead`` for groups coded 0 to ``codes - 1`` that are ordered by a BIGINT.

    Keys beyond the bits left by the code share the end values, which keeps the
    order and leaves their comparison to the columns behind the lead.
    """
    half = 1 << (62 - max(codes - 1, 1).bit_length() - 1)
    clamped = F.least(F.greatest(key, F.lit(-half)), F.lit(half - 1))
    return code.cast("bigint") * F.lit(2 * half) + clamped + F.lit(half)


def positions_in_files(df: DataFrame, name: str = "pos") -> DataFrame:
    """0-based position in file-name order; rows are shuffled only beyond ``BROADCAST_FILES``.

    ``df`` must come straight from ``spark.read.parquet``; the row index inside
    each file is Spark's own metadata column.
    """
    located = df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )
    # One row per file.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        located.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")),
        "file-starts",
    )
    # A start is a path and a number: up to that many files, a few hundred MB at most.
    if starts.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return located.join(starts, "_file").select(
        *df.columns, (F.col("_start") + F.col("_index")).alias(name)
    )
