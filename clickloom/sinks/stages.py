"""Stages of a job that are kept, and reused only while what made them is unchanged.

Beside the rows of a stage lies a manifest: the parameters and the input that it was made from, and
a fingerprint of both. A stage is reused where its manifest has the fingerprint that it would get
now; otherwise it is built again. The manifest is written last and goes with the rows when they are
overwritten, so an unfinished stage never looks finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.rows import quoted

MANIFEST = "_clickloom_manifest.json"
FORMAT = 1  # raised when a stage writes other rows from the same input
_FIELDS = "spark.sql.debug.maxToStringFields"


def fingerprint(name: str, parameters: Mapping, upstream: Sequence[str] = ()) -> str:
    """Of a stage's name, its parameters (values that JSON can hold) and its inputs' fingerprints."""
    known = json.dumps([FORMAT, name, dict(parameters), list(upstream)], sort_keys=True, default=list)
    return hashlib.sha256(known.encode()).hexdigest()


def source_fingerprint(df: DataFrame) -> str:
    """Of the rows that ``df`` gives.

    A plan over files and ranges without Python functions or draws is known by its text and by the
    files' paths, sizes and times: no row is read. Anything else is known by a digest of its rows, in
    any order: one pass over the input.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = [(leaf, leaf.getClass().getSimpleName()) for leaf in map(leaves.apply, range(leaves.size()))]
    files = [leaf for leaf, kind in kinds if kind == "LogicalRelation" and _roots(leaf) is not None]
    plain = all(kind in ("Range", "OneRowRelation") for leaf, kind in kinds if leaf not in files)
    text = _plan_text(df)
    if not plain or not files or any(w in text for w in ("Python", "InArrow", "InPandas", "rand", "uuid", "shuffle(")):
        return fingerprint("rows", {"schema": df.schema.json()}, [_rows_digest(df)])
    roots = sorted({root for leaf in files for root in _roots(leaf)})
    return fingerprint(
        "files", {"schema": df.schema.json(), "plan": text, "roots": roots}, [_files_digest(df.sparkSession, roots)]
    )


def _roots(leaf) -> list[str] | None:
    """Root paths of a relation of files; None for any other."""
    relation = leaf.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return None
    paths = relation.location().rootPaths()
    return [paths.apply(i).toString() for i in range(paths.size())]


def _plan_text(df: DataFrame) -> str:
    """The analyzed plan without the numbers that differ from session to session."""
    spark = df.sparkSession
    before = spark.conf.get(_FIELDS)
    spark.conf.set(_FIELDS, str(2**31 - 1))
    try:
        return df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.set(_FIELDS, before)


def _added(hashes: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(hashes.cast("decimal(38,0)")).cast("string").alias("sum"),
        F.bit_xor(F.xxhash64(hashes, F.lit(1))).alias("xor"),
    ]


def _files_digest(spark: SparkSession, roots: Sequence[str]) -> str:
    """Paths, sizes and times of all files below ``roots``, listed by Spark and added up in tasks."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(list(roots)).select("path", "length", "modificationTime")
    return json.dumps(files.agg(*_added(F.xxhash64("path", "length", "modificationTime"))).first().asDict())


def _rows_digest(df: DataFrame) -> str:
    columns = []
    for field in df.schema.fields:
        column = quoted(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        if isinstance(field.dataType, T.VariantType):
            nested, column = False, F.to_json(column)
        # Hashing skips nulls: they are marked, inside nested values by their JSON form.
        columns += [F.to_json(F.struct(column)) if nested else column, column.isNull()]
    return json.dumps(df.agg(*_added(F.xxhash64(F.lit(0), *columns))).first().asDict())


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is at ``path``."""
    fs, marker = _file(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the stage at ``path``; None where there is none that can be read."""
    fs, at = _file(spark, f"{path}/{MANIFEST}")
    if not exists(spark, path) or not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except json.JSONDecodeError:
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) else None


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, at = _file(spark, f"{path}/{MANIFEST}")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True, default=list).encode()))
    finally:
        stream.close()


def write_if_changed(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    parameters: Mapping,
    upstream: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    recreate: bool = False,
) -> DataFrame:
    """The stage at ``path``; built and written again unless it was made from the same.

    ``parameters`` are whatever the rows of ``build`` depend on besides the inputs that ``upstream``
    has the fingerprints of. Output without a manifest was not written here or not finished: it is
    built again. ``recreate`` builds in any case.
    """
    wanted = fingerprint(path.rstrip("/").rsplit("/", 1)[-1], parameters, upstream)
    found = None if recreate else read_manifest(spark, path)
    if found is None or found.get("fingerprint") != wanted:
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        _write_manifest(
            spark, path, {"fingerprint": wanted, "parameters": dict(parameters), "upstream": list(upstream)}
        )
    return spark.read.parquet(path)


def write_if_absent(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], recreate: bool = False
) -> DataFrame:
    """The finished output at ``path``, whatever made it; built and written only when it is missing.

    ``write_if_changed`` also looks at what an output was made from.
    """
    if recreate or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
