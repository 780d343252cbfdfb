"""Whole-row projections built from the column roles of a FeatureSpec."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clickloom.functions import dense as D
from clickloom.spec import FeatureSpec

ColumnFn = Callable[[Column], Column]
# Of Arrow or NumPy arrays, see ``functions.arrays``.
ArrayFn = Callable[[Any], Any]
BatchFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def quoted(name: str) -> Column:
    """Column by exact name, also for names with dashes."""
    return F.col(f"`{name}`")


def apply_by_role(
    df: DataFrame,
    spec: FeatureSpec,
    dense: ColumnFn | None = None,
    sparse: ColumnFn | None = None,
    label: ColumnFn | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One ``select`` over any width: a function per role, ``keep`` untouched."""
    same: ColumnFn = lambda c: c
    roles = [(spec.label, label or same)]
    roles += [(c, dense or same) for c in spec.dense]
    roles += [(c, sparse or same) for c in spec.sparse]
    return df.select(
        *[quoted(c) for c in keep], *[fn(quoted(c)).alias(c) for c, fn in roles]
    )


def map_batches(df: DataFrame, fn: BatchFn, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, but such steps one after another run in one pass.

    Between them rows stay Arrow batches of a Python worker, where Spark would make rows of its own and
    batches again: for hundreds of columns that costs more than most work on them.
    """
    source, steps = batch_steps(df)
    steps = (*steps, fn)
    out = source.mapInArrow(lambda batches: reduce(lambda rows, step: step(rows), steps, batches), schema)
    out._batch_steps = source, steps
    return out


def batch_steps(df: DataFrame) -> tuple[DataFrame, tuple[BatchFn, ...]]:
    """The source and the steps of ``map_batches`` that ``df`` is made by."""
    return getattr(df, "_batch_steps", (df, ()))


def map_as_arrays(
    df: DataFrame, roles: Sequence[tuple[Sequence[str], Sequence[ArrayFn], T.DataType]], keep: Sequence[str] = ()
) -> DataFrame:
    """Functions one after another over many columns of one type each, for rows of hundreds of columns.

    Spark compiles no stage beyond ``spark.sql.codegen.maxFields`` columns, and what it makes for single
    columns is megabytes of code that every row runs through. Here a column of a batch is worked on at a
    time, by functions of ``functions.arrays``; each role names its columns, steps and resulting type.
    """
    names = [*keep, *[c for columns, _, _ in roles for c in columns]]
    # Columns that are not asked for need not reach the worker, unless they are made there.
    rows = df if batch_steps(df)[1] else df.select(*[quoted(c) for c in names])
    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([*kept, *[T.StructField(c, kind) for columns, _, kind in roles for c in columns]])
    work = [(columns, steps, to_arrow_type(kind)) for columns, steps, kind in roles]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in keep]
            for made_from, steps, kind in work:
                for c in made_from:
                    made = reduce(lambda v, fn: fn(v), steps, batch.column(c))
                    columns.append(made if isinstance(made, pa.Array) else pa.array(made, kind))
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(rows, mapped, schema)


def fill_missing_rows(
    df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()
) -> DataFrame:
    return apply_by_role(df, spec, D.fill_missing, D.fill_missing, keep=keep)


def row_to_tsv(df: DataFrame, columns: Sequence[str], delimiter: str = "\t") -> Column:
    """All columns of a row as one line; NULL becomes an empty field."""
    fields = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(delimiter, *fields)


def cast_output(
    df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()
) -> DataFrame:
    """Final types: BIGINT sparse, FLOAT clipped-and-logged dense, FLOAT label."""
    return apply_by_role(
        df,
        spec,
        dense=lambda c: D.log1p(D.neg_to_zero(c)).cast("float"),
        sparse=lambda c: c.cast("bigint"),
        label=D.label_float,
        keep=keep,
    )
