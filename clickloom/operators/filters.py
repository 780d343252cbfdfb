"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clickloom.functions.draws import uniform


def subsample_negatives(
    df: DataFrame, label: str, rate: float, row_key: str, seed: int = 0
) -> DataFrame:
    """Drop a negative row when its draw is below ``rate``; 0 keeps every row."""
    if rate <= 0:
        return df
    dropped = (F.col(label) == 0) & (uniform(seed, F.col(row_key)) < rate)
    return df.where(~F.coalesce(dropped, F.lit(False)))


def drop_null_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_bad_rows(
    df: DataFrame, good: Column, metrics: Observation | None = None
) -> DataFrame:
    """Keep rows where ``good`` holds; count the others in ``metrics``."""
    good = F.coalesce(good, F.lit(False))
    if metrics is not None:
        df = df.observe(
            metrics,
            F.count(F.lit(1)).alias("processed"),
            F.count_if(~good).alias("skipped"),
        )
    return df.where(good)
