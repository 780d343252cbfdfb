"""The registry of queries, the click-log view they share, and SQL helpers.

Every query is registered with the SQL that must give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.rows import map_batches
from clickloom.plans.jobs import WIDE_COLUMNS
from clickloom.session import spread, tune
from clickloom.spec import STANDARD, FeatureSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPLITS = 24
# Rows of the click log that one task makes: about 1 KB each, from some 20 bytes of an event.
TASK_ROWS = 250_000
M = 8192
M_LARGE = 2**29
DENSE = STANDARD.dense
SPARSE = STANDARD.sparse
ROW = ["row_id", "split"]

# Tasks get the functions that make wide rows with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the click-log view over ``events`` -------------------------------------


def clicklog(spark: SparkSession, sf_dir: str, spec: FeatureSpec = STANDARD) -> DataFrame:
    """Raw text click log: one row per event, with missing fields."""
    if len(spec.columns) > WIDE_COLUMNS:
        return wide_clicklog(spark, sf_dir, spec)
    e = F.col("event_id")
    keys = [
        F.col("user_id").cast("string"),
        F.col("event_type"),
        (e % 97).cast("string"),
        e.cast("string"),
    ]
    columns = [F.when(F.col("event_type") == "click", 1).otherwise(0).alias(spec.label)]
    for j, c in enumerate(spec.dense, start=1):
        value = ((e * (j + 3)) % 2001 - 1000).cast("string")
        columns.append(F.when((e * 31 + j * 7) % 11 == 0, "").otherwise(value).alias(c))
    for j, c in enumerate(spec.sparse, start=1 + len(spec.dense)):
        value = F.substring(F.md5(F.concat(F.lit(f"{j}|"), keys[j % 4])), 1, 8)
        columns.append(F.when((e + j) % 13 == 0, "").otherwise(value).alias(c))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = TASK_ROWS * len(STANDARD.columns) // len(spec.columns)
    return spread(events, rows).select(
        e.alias("row_id"), (e % SPLITS).cast("int").alias("split"), *columns
    )


def wide_clicklog(spark: SparkSession, sf_dir: str, spec: FeatureSpec) -> DataFrame:
    """The same rows for specs of hundreds of columns, made a column of a batch at a time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = TASK_ROWS * len(STANDARD.columns) // len(spec.columns)
    ids = "row_id BIGINT, split INT, "
    text = ", ".join(f"`{c}` STRING" for c in (*spec.dense, *spec.sparse))
    names, n_dense, n_sparse = [*ROW, *spec.columns], len(spec.dense), len(spec.sparse)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_wide_columns(batch, n_dense, n_sparse), names)

    return map_batches(spread(events, rows), made, f"{ids}`{spec.label}` INT, {text}")


def _wide_columns(batch: pa.RecordBatch, n_dense: int, n_sparse: int) -> list[pa.Array]:
    event_id, user_id, event_type = batch.columns
    unknown = event_id.is_null().to_numpy(zero_copy_only=False)
    e = pc.fill_null(event_id, 0).to_numpy(zero_copy_only=False)
    if len(e) and max(-int(e.min()), int(e.max())) > (2**63 - 1) // (n_dense + 60) - n_dense:
        raise OverflowError("event_id is too large")
    click = pc.fill_null(pc.equal(event_type, "click"), False).cast(pa.int32())
    columns = [event_id, pa.array(np.fmod(e, SPLITS), pa.int32(), mask=unknown), click]
    # The text of every possible dense value, and that of a missing field behind them.
    texts = pa.array([*map(str, range(-3000, 1001)), ""], pa.string())
    left, fits, of_13 = np.fmod(e, 2001).astype(np.int32), np.mod(np.mod(e, 11) * 31, 11), np.mod(e, 13)
    for j in range(1, n_dense + 1):
        at = np.fmod(left * np.int32(j + 3), np.int32(2001)) + np.int32(2000)
        at[fits == -7 * j % 11] = len(texts) - 1
        columns.append(texts.take(pa.array(at, mask=unknown)))
    keys = [user_id.cast(pa.string()), event_type, pa.array(np.fmod(e, 97), mask=unknown).cast(pa.string()),
            event_id.cast(pa.string())]
    coded = [k.dictionary_encode() for k in keys]
    codes = [pc.fill_null(k.indices, -1).to_numpy(zero_copy_only=False) for k in coded]
    for j in range(1 + n_dense, 1 + n_dense + n_sparse):
        names, at = coded[j % 4].dictionary.to_pylist(), codes[j % 4].copy()
        digests = [md5(f"{j}|{x}".encode(), usedforsecurity=False).hexdigest()[:8] for x in names]
        at[(of_13 == -j % 13) & ~unknown] = len(names)
        columns.append(pa.array([*digests, ""], pa.string()).take(pa.array(at, mask=at < 0)))
    return columns


def clicklog_sql(spec: FeatureSpec = STANDARD) -> str:
    keys = [
        "cast(user_id as varchar)",
        "event_type",
        "cast(event_id % 97 as varchar)",
        "cast(event_id as varchar)",
    ]
    columns = [f"case when event_type = 'click' then 1 else 0 end AS {spec.label}"]
    for j, c in enumerate(spec.dense, start=1):
        columns.append(
            f"case when (event_id * 31 + {j * 7}) % 11 = 0 then '' "
            f"else cast((event_id * {j + 3}) % 2001 - 1000 as varchar) end AS {c}"
        )
    for j, c in enumerate(spec.sparse, start=1 + len(spec.dense)):
        columns.append(
            f"case when (event_id + {j}) % 13 = 0 then '' "
            f"else substr(md5(concat('{j}|', {keys[j % 4]})), 1, 8) end AS {c}"
        )
    return (
        f"SELECT event_id AS row_id, cast(event_id % {SPLITS} as integer) AS split, "
        + ", ".join(columns)
        + " FROM events"
    )


# --- SQL fragments ----------------------------------------------------------


def fill(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '0')"


def hexv(c: str) -> str:
    return f"('0x' || {fill(c)})::bigint"


def hexmod(c: str, m: int = M) -> str:
    return f"{hexv(c)} % {m}"


def clip_log(c: str) -> str:
    return f"round(ln(greatest(cast({fill(c)} as double), 0) + 1), 6)"


def draw_sql(seed: int, key: str) -> str:
    return f"('0x' || substr(md5(concat('{seed}|', cast({key} as varchar))), 1, 15))::bigint"


def listed(columns, fn) -> str:
    return ", ".join(f"{fn(c)} AS {c}" for c in columns)


def with_f1(body: str, spec: FeatureSpec = STANDARD, more: str = "") -> str:
    return f"WITH f1 AS ({clicklog_sql(spec)}){more} {body}"


def prepared_sql(m: int = M, spec: FeatureSpec = STANDARD) -> str:
    """Click log after fill, clip, log and modulus; dense rounded."""
    return (
        f"SELECT row_id, split, {spec.label}, {listed(spec.dense, clip_log)}, "
        f"{listed(spec.sparse, lambda c: hexmod(c, m))} FROM f1"
    )


def cells_sql(m: int = M, source: str = "f1") -> str:
    """Long form of the reduced sparse columns."""
    return " UNION ALL ".join(
        f"SELECT row_id, split, '{c}' AS feature, {hexmod(c, m)} AS value FROM {source}"
        for c in SPARSE
    )


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def reduced(spark: SparkSession, sf_dir: str, m: int = M) -> DataFrame:
    """Row id, split and reduced sparse columns."""
    from clickloom.functions.dense import fill_missing
    from clickloom.functions.sparse import hex_mod

    return clicklog(spark, sf_dir).select(
        *ROW, *[hex_mod(fill_missing(c), m).alias(c) for c in SPARSE]
    )
