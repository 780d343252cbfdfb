"""Row-wise projections and filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import dense as D
from clickloom.functions import rows as R
from clickloom.functions import sparse as S
from clickloom.operators import filters
from clickloom.spec import STANDARD
from registry.base import (
    DENSE, M, M_LARGE, ROW, SPARSE, clicklog, clip_log, draw_sql, fill, hexmod, hexv,
    listed, query, rounded, with_f1, table,
)

ALL = (*DENSE, *SPARSE)


@query("fill_missing", with_f1(f"SELECT row_id, split, col_0, {listed(ALL, fill)} FROM f1"))
def fill_missing(spark, sf):
    return R.fill_missing_rows(
        clicklog(spark, sf).withColumn("col_0", F.col("col_0").cast("string")), STANDARD, ROW
    ).withColumn("col_0", F.col("col_0").cast("int"))


@query(
    "fill_missing_typed",
    with_f1(
        "SELECT row_id, "
        + listed(DENSE, lambda c: f"coalesce(cast(nullif({c}, '') as double), 0.0)")
        + ", " + listed(SPARSE, fill) + " FROM f1"
    ),
)
def fill_missing_typed(spark, sf):
    f1 = clicklog(spark, sf)
    typed = f1.select(
        "row_id",
        *[F.nullif(F.col(c), F.lit("")).cast("double").alias(c) for c in DENSE],
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in SPARSE],
    )
    return D.fill_missing_typed(typed, DENSE, SPARSE)


def _whole(c: str) -> str:
    return f"cast({fill(c)} as integer)"


@query("neg_to_zero", with_f1(f"SELECT row_id, {listed(DENSE, lambda c: f'greatest({_whole(c)}, 0)')} FROM f1"))
def neg_to_zero(spark, sf):
    return clicklog(spark, sf).select(
        "row_id", *[D.neg_to_zero(D.fill_missing(c).cast("int")).alias(c) for c in DENSE]
    )


@query("log1p", with_f1(f"SELECT row_id, {listed(DENSE, lambda c: f'round(ln(abs({_whole(c)}) + 1), 6)')} FROM f1"))
def log1p(spark, sf):
    return clicklog(spark, sf).select(
        "row_id",
        *[F.round(D.log1p(F.abs(D.fill_missing(c).cast("int"))), 6).alias(c) for c in DENSE],
    )


@query("neg_to_zero_log", with_f1(f"SELECT row_id, {listed(DENSE, clip_log)} FROM f1"))
def neg_to_zero_log(spark, sf):
    return clicklog(spark, sf).select(
        "row_id",
        *[F.round(D.neg_to_zero_log(D.fill_missing(c)), 6).alias(c) for c in DENSE],
    )


@query(
    "neg_to_zero_log_lenient",
    "SELECT event_id, round(ln(greatest(value, 0) + 1), 6) AS value_log, "
    "round(ln(greatest(coalesce(try_cast(event_type as double), 0), 0) + 1), 6) AS type_log, "
    "round(ln(greatest(value - 50, 0) + 1), 6) AS shifted_log FROM events",
)
def neg_to_zero_log_lenient(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    lenient = D.neg_to_zero_log_lenient
    return events.select(
        "event_id",
        F.round(lenient(F.col("value").cast("string")), 6).alias("value_log"),
        F.round(lenient(F.col("event_type")), 6).alias("type_log"),
        F.round(lenient(F.col("value") - 50), 6).alias("shifted_log"),
    )


@query("hex_to_int", with_f1(f"SELECT row_id, {listed(SPARSE, hexv)} FROM f1"))
def hex_to_int(spark, sf):
    return clicklog(spark, sf).select(
        "row_id", *[S.hex_to_int(D.fill_missing(c)).alias(c) for c in SPARSE]
    )


@query(
    "modulus",
    with_f1(f"SELECT row_id, {listed(DENSE, lambda c: f'(({_whole(c)} % 7) + 7) % 7')} FROM f1"),
)
def modulus(spark, sf):
    out = clicklog(spark, sf).select(
        "row_id", *[S.modulus(D.fill_missing(c).cast("int"), 7).cast("int").alias(c) for c in DENSE]
    )
    return out


@query(
    "hex_mod",
    with_f1(
        f"SELECT row_id, {listed(SPARSE, hexmod)}, "
        f"{hexmod('col_15', M_LARGE)} AS col_15_large, row_id % {M} AS id_mod FROM f1"
    ),
)
def hex_mod(spark, sf):
    return clicklog(spark, sf).select(
        "row_id",
        *[S.hex_mod(D.fill_missing(c), M).alias(c) for c in SPARSE],
        S.hex_mod(D.fill_missing("col_15"), M_LARGE).alias("col_15_large"),
        S.hex_mod(F.col("row_id"), M, T.LongType()).alias("id_mod"),
    )


_DIGITS = "lpad(substr(md5(cast(event_id as varchar)), 1, cast(event_id % 30 + 1 as integer)), 30, '0')"


def _long_mod_sql(m: int) -> str:
    """Thirty digits in two halves that fit a BIGINT."""
    high, low = f"('0x' || substr({_DIGITS}, 1, 15))::bigint", f"('0x' || substr({_DIGITS}, 16))::bigint"
    return f"cast(({high} % {m} * {16**15 % m} + {low} % {m}) % {m} as bigint)"


@query(
    "hex_mod_any_length",
    f"SELECT event_id, {_long_mod_sql(M)} AS strict, {_long_mod_sql(M_LARGE)} AS strict_large, "
    f"{_long_mod_sql(M)} AS lenient FROM events",
)
def hex_mod_any_length(spark, sf):
    """1 to 30 digits, every other row with zeros in front."""
    e = F.col("event_id")
    text = F.substr(F.md5(e.cast("string")), F.lit(1), (e % 30 + 1).cast("int"))
    text = F.when(e % 2 == 0, F.lpad(text, 40, "0")).otherwise(text)
    return table(spark, sf, "events").select(
        "event_id",
        S.hex_mod(text, M).alias("strict"),
        S.hex_mod(text, M_LARGE).alias("strict_large"),
        S.hex_mod_lenient(text, M).alias("lenient"),
    )


@query(
    "hex_mod_lenient",
    "WITH b AS (SELECT event_id, event_type, substr(md5(cast(event_id as varchar)), 1, 6) || "
    "case when event_id % 3 = 0 then 'g' else 'e' end AS mixed FROM events) "
    f"SELECT event_id, coalesce(try_cast('0x' || event_type as bigint) % {M}, 0) AS type_id, "
    f"case when mixed like '%g' then 0 else ('0x' || mixed)::bigint % {M} end AS mixed_id, "
    f"cast(case when mixed like '%g' then 0 else ('0x' || mixed)::bigint % {M} end as varchar) "
    "AS mixed_text FROM b",
)
def hex_mod_lenient(spark, sf):
    e = F.col("event_id")
    tail = F.when(e % 3 == 0, "g").otherwise("e")
    mixed = F.concat(F.substring(F.md5(e.cast("string")), 1, 6), tail)
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        S.hex_mod_lenient(F.col("event_type"), M).alias("type_id"),
        S.hex_mod_lenient(mixed, M).alias("mixed_id"),
        S.hex_mod_lenient(mixed, M).cast("string").alias("mixed_text"),
    )


@query(
    "int_mod_lenient",
    with_f1(
        "SELECT row_id, "
        + listed(DENSE, lambda c: f"coalesce(((try_cast({c} as bigint) % 100) + 100) % 100, 0)")
        + " FROM f1"
    ),
)
def int_mod_lenient(spark, sf):
    return clicklog(spark, sf).select(
        "row_id", *[S.int_mod_lenient(F.col(c), 100).alias(c) for c in DENSE]
    )


@query(
    "hex_wrap_int32",
    with_f1(
        "SELECT row_id, "
        + listed(
            SPARSE,
            lambda c: f"cast(case when {hexv(c)} >= 2147483648 then {hexv(c)} - 4294967296 "
            f"else {hexv(c)} end as integer)",
        )
        + " FROM f1"
    ),
)
def hex_wrap_int32(spark, sf):
    return clicklog(spark, sf).select(
        "row_id", *[S.hex_wrap_int32(D.fill_missing(c)).alias(c) for c in SPARSE]
    )


def _short(c: str) -> str:
    return f"substr({fill(c)}, 1, cast(1 + row_id % 8 as integer))"


@query("hex_zero_pad", with_f1(f"SELECT row_id, {listed(SPARSE, lambda c: f'lpad({_short(c)}, 8, {chr(39)}0{chr(39)})')} FROM f1"))
def hex_zero_pad(spark, sf):
    length = (1 + F.col("row_id") % 8).cast("int")
    return clicklog(spark, sf).select(
        "row_id",
        *[S.hex_zero_pad(F.substr(D.fill_missing(c), F.lit(1), length)).alias(c) for c in SPARSE],
    )


@query("int_to_hex", with_f1(f"SELECT row_id, {listed(SPARSE, lambda c: f'printf({chr(39)}%08X{chr(39)}, {hexv(c)})')} FROM f1"))
def int_to_hex(spark, sf):
    return clicklog(spark, sf).select(
        "row_id", *[S.int_to_hex(S.hex_to_int(D.fill_missing(c))).alias(c) for c in SPARSE]
    )


@query(
    "label_cast",
    with_f1("SELECT row_id, col_0 AS label_int, cast(col_0 as float) AS label_float FROM f1"),
)
def label_cast(spark, sf):
    text = F.col("col_0").cast("string")
    return clicklog(spark, sf).select(
        "row_id", D.label_int(text).alias("label_int"), D.label_float(text).alias("label_float")
    )


@query(
    "row_to_tsv",
    with_f1(
        "SELECT row_id, "
        + " || chr(9) || ".join(["cast(col_0 as varchar)", *ALL])
        + " AS line FROM f1"
    ),
)
def row_to_tsv(spark, sf):
    f1 = clicklog(spark, sf)
    return f1.select("row_id", R.row_to_tsv(f1, STANDARD.columns).alias("line"))


@query(
    "apply_by_role",
    with_f1(f"SELECT row_id, split, col_0, {listed(DENSE, clip_log)}, {listed(SPARSE, hexmod)} FROM f1"),
)
def apply_by_role(spark, sf):
    return R.apply_by_role(
        clicklog(spark, sf),
        STANDARD,
        dense=lambda c: F.round(D.neg_to_zero_log(D.fill_missing(c)), 6),
        sparse=lambda c: S.hex_mod(D.fill_missing(c), M),
        keep=ROW,
    )


@query(
    "cast_output",
    with_f1(
        "SELECT row_id, cast(col_0 as float) AS col_0, "
        + listed(DENSE, lambda c: f"round(cast(cast(ln(greatest({_whole(c)}, 0) + 1) as float) as double), 5)")
        + f", {listed(SPARSE, hexmod)} FROM f1"
    ),
)
def cast_output(spark, sf):
    typed = R.apply_by_role(
        clicklog(spark, sf),
        STANDARD,
        dense=lambda c: D.fill_missing(c).cast("int"),
        sparse=lambda c: S.hex_mod(D.fill_missing(c), M),
        keep=["row_id"],
    )
    out = R.cast_output(typed, STANDARD, ["row_id"])
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in DENSE}), DENSE, 5)


# --- filters ----------------------------------------------------------------


@query(
    "subsample_negatives",
    with_f1(
        "SELECT row_id, split, col_0 FROM f1 WHERE NOT (col_0 = 0 AND "
        f"cast({draw_sql(11, 'row_id')} as double) / 1152921504606846976.0 < 0.5)"
    ),
)
def subsample_negatives(spark, sf):
    f1 = clicklog(spark, sf).select(*ROW, "col_0")
    return filters.subsample_negatives(f1, "col_0", 0.5, "row_id", seed=11)


@query(
    "drop_null_values",
    with_f1("SELECT row_id, col_14 FROM f1 WHERE col_14 <> ''"),
)
def drop_null_values(spark, sf):
    f1 = clicklog(spark, sf).select("row_id", F.nullif(F.col("col_14"), F.lit("")).alias("col_14"))
    return filters.drop_null_values(f1, "col_14")


@query(
    "drop_bad_rows",
    with_f1(
        "SELECT row_id, cast(col_1 as bigint) AS col_1, ('0x' || col_14)::bigint AS col_14 "
        "FROM f1 WHERE col_1 <> '' AND col_14 <> ''"
    ),
)
def drop_bad_rows(spark, sf):
    parsed = clicklog(spark, sf).select(
        "row_id",
        F.col("col_1").try_cast("bigint").alias("col_1"),
        S.hex_or_null(F.col("col_14")).alias("col_14"),
    )
    good = F.col("col_1").isNotNull() & F.col("col_14").isNotNull()
    return filters.drop_bad_rows(parsed, good)


# --- user functions ---------------------------------------------------------


@query("udf_elementwise", with_f1(f"SELECT row_id, {listed(DENSE, clip_log)} FROM f1"))
def udf_elementwise(spark, sf):
    @F.pandas_udf("double")
    def clip_and_log(c: pd.Series) -> pd.Series:
        return np.log1p(c.clip(lower=0))

    return clicklog(spark, sf).select(
        "row_id",
        *[F.round(clip_and_log(D.fill_missing(c).cast("double")), 6).alias(c) for c in DENSE],
    )


@query("udf_column", with_f1(f"SELECT row_id, split, col_0, {listed(DENSE, fill)}, {listed(SPARSE, hexmod)} FROM f1"))
def udf_column(spark, sf):
    return R.apply_by_role(
        clicklog(spark, sf),
        STANDARD,
        dense=D.fill_missing,
        sparse=lambda col: S.hex_to_int(D.fill_missing(col)) % M,
        keep=ROW,
    )


@query(
    "udf_row",
    with_f1(
        "SELECT row_id, cast(col_1 as bigint) AS col_1, ('0x' || col_14)::bigint AS col_14 "
        "FROM f1 WHERE col_1 <> '' AND col_14 <> ''"
    ),
)
def udf_row(spark, sf):
    def parse(batches):
        for rows in batches:
            rows = rows[(rows["col_1"] != "") & (rows["col_14"] != "")]
            yield rows.assign(
                col_1=rows["col_1"].astype("int64"),
                col_14=rows["col_14"].map(lambda v: int(v, 16)).astype("int64"),
            )

    return clicklog(spark, sf).select("row_id", "col_1", "col_14").mapInPandas(
        parse, "row_id BIGINT, col_1 BIGINT, col_14 BIGINT"
    )


@query(
    "chain_ops",
    with_f1(f"SELECT row_id, col_0, {listed(DENSE, clip_log)}, {listed(SPARSE, hexmod)} FROM f1"),
)
def chain_ops(spark, sf):
    def each(names, fn):
        return lambda df: df.withColumns({c: fn(F.col(c)) for c in names})

    return (
        clicklog(spark, sf)
        .transform(each([*DENSE, *SPARSE], D.fill_missing))
        .transform(each(DENSE, lambda c: D.neg_to_zero(c.cast("double"))))
        .transform(each(DENSE, lambda c: F.round(D.log1p(c), 6)))
        .transform(each(SPARSE, lambda c: S.hex_mod(c, M)))
        .drop("split")
    )


@query(
    "row_metrics",
    with_f1(
        "SELECT count(*) AS processed, count(*) - "
        "count(case when col_1 <> '' and col_14 <> '' then 1 end) AS skipped FROM f1"
    ),
)
def row_metrics(spark, sf):
    from clickloom.plans.timing import seconds

    metrics = Observation("rows")
    parsed = clicklog(spark, sf).select("col_1", "col_14")
    good = (F.col("col_1") != "") & (F.col("col_14") != "")
    seconds(filters.drop_bad_rows(parsed, good, metrics))
    counted = metrics.get
    return spark.createDataFrame(
        [(counted["processed"], counted["skipped"])], "processed BIGINT, skipped BIGINT"
    )
