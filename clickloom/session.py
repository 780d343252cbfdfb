"""Session settings and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# HotSpot does not compile methods above this many bytes of bytecode, so a
# fused stage of 39 feature expressions would run interpreted (about 4x slower).
JIT_METHOD_BYTES = "8000"
_SPARK_DEFAULT_METHOD_BYTES = "65535"


def tune(spark: SparkSession) -> SparkSession:
    """Settings that wide feature projections need; user choices are kept."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, _SPARK_DEFAULT_METHOD_BYTES) == _SPARK_DEFAULT_METHOD_BYTES:
        spark.conf.set(key, JIT_METHOD_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder
    of this machine: on a cluster the executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal the rows of a few large splits to all cores, before costly work.

    An input with at least as many splits as cores comes back as it is, unless ``rows`` are given:
    then there are as many parts that none is dealt more than ``rows`` rows, for work whose rows are
    far larger than those read. Plain files are counted from their footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    wanted = cores if rows is None else max(cores, -(-df.count() // rows))
    return df if parts >= wanted else df.repartition(wanted)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle that names no number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimizer the true size, so it broadcasts the result only when it is small.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``store`` that also returns the row count, measured during the write."""
    rows = Observation()
    stored = store(df.observe(rows, F.count(F.lit(1)).alias("rows")), name)
    return stored, rows.get["rows"]
