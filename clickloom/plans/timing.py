"""Timing of single operators and of scans."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clickloom.functions.rows import quoted
from clickloom.operators.stats import file_inventory


def seconds(df: DataFrame) -> float:
    """Wall time to compute every row and column of ``df`` without keeping them."""
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def time_operators(
    df: DataFrame, operators: Mapping[str, Callable[[Column], Column]], columns: Sequence[str]
) -> DataFrame:
    """Run each operator alone over a group of columns.

    One row per operator: columns, rows it produced and seconds.
    """
    results = []
    for name, operator in operators.items():
        rows = Observation()
        out = df.select(*[operator(quoted(c)).alias(c) for c in columns])
        took = seconds(out.observe(rows, F.count(F.lit(1)).alias("n")))
        results.append((name, len(columns), rows.get["n"], took))
    return df.sparkSession.createDataFrame(
        results, "operator STRING, columns INT, n BIGINT, seconds DOUBLE"
    )


def time_scan(df: DataFrame) -> DataFrame:
    """Files, rows, bytes, seconds, rows/s and GB/s of reading a file scan whole."""
    took = seconds(df)
    totals = file_inventory(df).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    return totals.select(
        "files",
        "n",
        "bytes",
        F.lit(took).alias("seconds"),
        (F.col("n") / took).alias("rows_per_second"),
        (F.col("bytes") / 1e9 / took).alias("gb_per_second"),
    )
