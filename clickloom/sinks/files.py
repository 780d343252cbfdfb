"""Parquet, text and TFRecord outputs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.rows import row_to_tsv
from clickloom.functions.vectors import pad_vector
from clickloom.operators.splits import block_bounds, block_of
from clickloom.sinks.stages import exists, write_if_absent, write_if_changed  # noqa: F401
from clickloom.sources.clicklog import file_ordinal
from clickloom.sources.tfrecord import read_tfrecords, write_tfrecords

# Rows per group when small files are merged.
COMPACT_GROUP_ROWS = 3_000_000
# Bytes of rows that a task holds while it deals them to files.
DEALT_BYTES = 64 * 1024 * 1024


def write_snappy(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def write_row_groups(
    df: DataFrame, path: str, rows: int, partition_by: Sequence[str] = ()
) -> None:
    """Uncompressed Parquet with ``rows`` rows in each row group."""
    writer = df.write.option("compression", "none")
    writer = writer.option("parquet.block.row.count.limit", rows)
    writer.partitionBy(*partition_by).parquet(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int = 1024) -> None:
    """``shards`` contiguous runs of rows, one folder ``shard=NNNN`` each.

    Sizes differ by at most one row. Rows move once, straight to their shard's
    task; a shard holds 1/``shards`` of the rows, so no task is heavier.
    """
    shard = block_of(F.col(key), block_bounds(df, key, shards))
    (
        df.withColumn("shard", F.lpad(shard.cast("string"), 4, "0"))
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", key)
        .write.partitionBy("shard")
        .parquet(path)
    )


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    files_per_group: int = 16,
    rows: int = COMPACT_GROUP_ROWS,
    tasks_per_group: int = 1,
    pattern: str = r"part[-_](\d+)",
) -> None:
    """Merge each run of ``files_per_group`` numbered files into larger files.

    Every group ends up in ``tasks_per_group`` files in folder ``group=N``.
    """
    df = spark.read.parquet(source)
    grouped = df.select("*", F.floor(file_ordinal(pattern) / files_per_group).cast("int").alias("group"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(tasks_per_group))
    write_row_groups(grouped.repartition("group", spread), target, rows, ["group"])


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Rows as tab-separated text without a header; NULL is an empty field."""
    df.select(row_to_tsv(df, columns or df.columns).alias("value")).write.text(path)


def dealt_to_files(df: DataFrame, files: int, held_bytes: int = DEALT_BYTES) -> DataFrame:
    """The rows of ``df`` in ``files`` partitions of about equal size, shuffled as compressed runs of rows.

    Each task deals its rows in turn, starting at its own number. Far fewer bytes move than row by row,
    as a run is compressed as a whole; a task holds at most ``held_bytes`` and one batch. ``df`` must
    give the same rows in the same order when a task is retried, as a scan of files does.
    """
    names = df.columns

    def packed(parts: list[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        for k in range(min(files, table.num_rows)):
            run = table.take(np.arange(k, table.num_rows, files)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(run)
            yield pa.record_batch([pa.array([(at + k) % files], pa.int32()), [sink.getvalue().to_pybytes()]], ["file", "run"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, rows = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            parts.append(batch)
            held += batch.nbytes
            rows += batch.num_rows
            if held >= held_bytes:
                yield from packed(parts, at)
                at, parts, held, rows = at + rows, [], 0, 0
        if rows:
            yield from packed(parts, at)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch["run"]:
                for part in pa.ipc.open_stream(run.as_buffer()):
                    yield part.rename_columns(names)

    runs = df.mapInArrow(pack, "file int, run binary").repartitionById(files, F.col("file"))
    return runs.mapInArrow(unpack, df.schema)


def reshard_text(spark: SparkSession, source: str, target: str, files: int = 256) -> None:
    dealt_to_files(spark.read.text(source), files).write.text(target)


def reshard_tfrecords(spark: SparkSession, source: str, target: str, files: int = 256) -> None:
    write_tfrecords(dealt_to_files(read_tfrecords(spark, source), files), target)


def write_vocabulary(vocabulary: DataFrame, path: str, kind: str = "parquet") -> None:
    """Keep a vocabulary by feature.

    ``parquet`` can be read back; ``json`` has one object per entry; ``text``
    lists the values of each feature in id order, one per line.
    """
    if kind == "text":
        lines = vocabulary.repartitionByRange("feature", "idx").sortWithinPartitions(
            "feature", "idx"
        )
        lines = lines.select("feature", F.col("value").cast("string").alias("value"))
        lines.write.partitionBy("feature").text(path)
        return
    writer = vocabulary.select("value", "idx", "cnt", "feature").write.partitionBy("feature")
    getattr(writer, kind)(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary kept as Parquet; its values have the type they were kept with."""
    kind = spark.read.parquet(path).schema["value"].dataType.simpleString()
    schema = f"value {kind}, idx BIGINT, cnt BIGINT, feature STRING"
    return spark.read.schema(schema).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split; rows are written by the tasks that hold them."""
    df.write.partitionBy(split).parquet(path)


def write_padded_vectors(words: DataFrame, path: str, zeros: int) -> None:
    """Word table with ``zeros`` zeros after each vector, in word order."""
    padded: Column = pad_vector(F.col("vec"), zeros)
    ordered = words.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.withColumn("vec", padded).write.parquet(path)
