"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import new_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The letters that the contracts lower-case, and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, drop the shuffle files of that job, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column | str) -> Column:
    return F.translate(column, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode().split() if text else []


ROWS = 1024  # texts that a task holds as Python strings at once


def texts_of(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """Parts of each batch with their texts as Python strings, null as None.

    Arrow's pool keeps what a batch needed; it is given back before the next one, because the
    worker process lives on and serves other stages.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
        pa.default_memory_pool().release_unused()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v
