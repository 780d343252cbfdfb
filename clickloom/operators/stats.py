"""Counts and checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.splits import rows_per_split


def rows_and_total(df: DataFrame, split: str) -> DataFrame:
    """Rows per split, and their total in a row where the split is NULL."""
    return df.rollup(split).agg(F.count(F.lit(1)).alias("n"))


def label_counts_per_split(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )


def global_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def check_split_sizes(before: DataFrame, after: DataFrame, split: str) -> DataFrame:
    """Splits whose row count changed; no rows means the check passed."""
    old = rows_per_split(before, split).withColumnRenamed("n", "expected")
    new = rows_per_split(after, split).withColumnRenamed("n", "found")
    joined = old.join(new, split, "full").na.fill(0, ["expected", "found"])
    return joined.where(F.col("expected") != F.col("found"))


def reorder_norm(
    left: DataFrame, right: DataFrame, split: str, position: str, columns: Sequence[str]
) -> DataFrame:
    """L2 norm, per split, of the difference of two versions row by row."""
    a = left.select(split, position, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(split, position, *[F.col(c).alias(f"_b_{c}") for c in columns])
    squares = sum(
        (F.pow(F.col(f"_a_{c}").cast("double") - F.col(f"_b_{c}").cast("double"), 2))
        for c in columns
    )
    return (
        a.join(b, [split, position])
        .groupBy(split)
        .agg(F.sqrt(F.sum(squares)).alias("norm"))
    )


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind ``df``, a plain file scan."""
    return (
        df.select(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_size").alias("bytes"),
        )
        .groupBy("file", "bytes")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Bytes of one value in a packed column of this type.
_WIDTHS = {
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
}


def column_manifest(df: DataFrame) -> DataFrame:
    """Packed size and offset of each column: one row per column."""
    widths, offset = [], 0
    for field in df.schema.fields:
        width = _WIDTHS[type(field.dataType)]
        widths.append((field.name, field.dataType.simpleString(), width, offset))
        offset += width
    entry = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(kind).alias("dtype"),
                (F.col("n") * before).alias("offset"),
                (F.col("n") * width).alias("size"),
            )
            for name, kind, width, before in widths
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("num_rows"), F.inline(entry)
    )


def vocabulary_lengths(words: DataFrame, floor: int = 25) -> DataFrame:
    """Word-table size, vector size and word lengths counted at least ``floor``."""
    length = F.char_length("word")
    floored = F.greatest(length, F.lit(floor)).cast("bigint")
    return words.agg(
        F.count(F.lit(1)).alias("words"),
        F.max(F.size("vec")).alias("vector_size"),
        F.max(length).alias("max_length"),
        F.sum(floored).alias("total_length"),
        F.avg(floored).alias("average_length"),
    )


def running_max_words(words: DataFrame) -> DataFrame:
    """Words longer than every word before them, by ``idx``.

    Only the first word of each length can set a record, so the running
    maximum is taken over one row per length.
    """
    firsts = words.groupBy(F.char_length("word").alias("length")).agg(
        F.min("idx").alias("idx"), F.min_by("word", "idx").alias("word")
    )
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    first_longer = firsts.withColumn("_longer", F.min("idx").over(longer))
    record = F.col("_longer").isNull() | (F.col("_longer") > F.col("idx"))
    # An empty word is never longer than the start value 0.
    return first_longer.where(record & (F.col("length") > 0)).drop("_longer")


@contextmanager
def _footers(spark: SparkSession) -> Iterator[None]:
    """Spark pushes counts into Parquet footers only through its newer file source."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _counted(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def footer_counts(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of Parquet files, in all or by folder columns, from their footers: no row is decoded."""
    with _footers(spark):
        counted = _counted(spark, path, by)
        return spark.createDataFrame(counted.collect(), counted.schema)  # one row per folder, or one


def footer_plan(spark: SparkSession, path: str, by: Sequence[str] = ()) -> str:
    """How ``footer_counts`` is run."""
    with _footers(spark):
        return _counted(spark, path, by)._jdf.queryExecution().executedPlan().toString()
