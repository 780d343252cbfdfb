"""Click logs in text and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.rows import quoted
from clickloom.spec import FeatureSpec


def read_tsv(
    spark: SparkSession, path: str, spec: FeatureSpec, extra: str = ""
) -> DataFrame:
    """Header-less tab-separated click log; all fields are text.

    ``extra`` names leading columns (a DDL schema) that come before the label.
    Missing fields are NULL.
    """
    schema = spec.struct()
    ddl = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    return spark.read.csv(
        path,
        schema=f"{extra}, {ddl}" if extra else ddl,
        sep="\t",
        header=False,
        quote="",
        escape="",
        mode="FAILFAST",
    )


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns are read from the files."""
    return spark.read.parquet(path).select(*[quoted(c) for c in columns])


def read_glob(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder whose names match; no match is an error."""
    reader = spark.read.option("pathGlobFilter", pattern)
    try:
        return reader.parquet(folder)
    except Exception as failure:
        if "UNABLE_TO_INFER_SCHEMA" in str(failure):
            raise FileNotFoundError(f"no file matches {folder}/{pattern}") from failure
        raise


def read_rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All columns of one or more Parquet paths, on any file system Spark knows."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def file_ordinal(pattern: str = r"part[-_](\d+)") -> Column:
    """The number in a row's file path, where ``pattern`` matches last."""
    found = F.regexp_extract_all("_metadata.file_path", F.lit(pattern), 1)
    return F.element_at(found, -1).cast("int")


def with_split_from_file(df: DataFrame, pattern: str, name: str = "split") -> DataFrame:
    """Split id of each row from the number in its file's path."""
    return df.select(*[quoted(c) for c in df.columns], file_ordinal(pattern).alias(name))
