"""End-to-end jobs and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import dense as D
from clickloom.functions import sparse as S
from clickloom.plans import jobs, timing
from clickloom.session import new_path
from clickloom.sources.clicklog import read_tsv, with_split_from_file
from clickloom.spec import STANDARD, WIDE, FeatureSpec
from registry.base import (
    DENSE, M, M_LARGE, ROW, SPARSE, SPLITS, cells_sql, clicklog, clip_log, draw_sql, fill,
    listed, prepared_sql, query, rounded, table, with_f1,
)
from registry.storage import text_log
from registry.vocabularies import vocab_cte

EXTRA = "row_id BIGINT, split INT"


@query("preprocess_no_vocab", with_f1(prepared_sql()))
def preprocess_no_vocab(spark, sf):
    return rounded(jobs.preprocess(clicklog(spark, sf), STANDARD, M, ROW), DENSE)


@query("preprocess_no_vocab_large", with_f1(prepared_sql(M_LARGE)))
def preprocess_no_vocab_large(spark, sf):
    return rounded(jobs.preprocess(clicklog(spark, sf), STANDARD, M_LARGE, ROW), DENSE)


@query("preprocess_wide", with_f1(prepared_sql(M, WIDE), WIDE))
def preprocess_wide(spark, sf):
    """504 dense and 42 sparse columns."""
    return jobs.preprocess(clicklog(spark, sf, WIDE), WIDE, M, ROW, places=6)


def encoded_sql(order: str, m: int = M, unseen: str = "idx", rows: str = "f1", more: str = "") -> str:
    """Prepared label and dense columns next to the ids of the sparse ones."""
    picks = ", ".join(f"max(case when feature = '{c}' then {unseen} end) AS {c}" for c in SPARSE)
    return with_f1(
        f"SELECT d.*, e.* EXCLUDE (row_id) FROM (SELECT row_id, split, col_0, {listed(DENSE, clip_log)} "
        f"FROM {rows}) d JOIN (SELECT row_id, {picks} FROM (SELECT x.*, v.idx FROM cells x "
        "LEFT JOIN voc v USING (feature, value)) GROUP BY row_id) e USING (row_id)",
        more=f"{more}, cells AS ({cells_sql(m, rows)})" + vocab_cte(order),
    )


@query("preprocess_with_vocab", encoded_sql("frequency"))
def preprocess_with_vocab(spark, sf):
    return rounded(jobs.preprocess_with_vocabulary(clicklog(spark, sf), STANDARD, M, ROW), DENSE)


@query("preprocess_apply_vocab", with_f1(prepared_sql()))
def preprocess_apply_vocab(spark, sf):
    return rounded(jobs.preprocess_with_identity(clicklog(spark, sf), STANDARD, M, ROW), DENSE)


@query("tsv_two_pass", encoded_sql("frequency", unseen="coalesce(idx, -1)"))
def tsv_two_pass(spark, sf):
    source = text_log(spark, sf)
    vocabulary, target = new_path(spark, "pass-1"), new_path(spark, "pass-2")
    jobs.two_pass_vocabulary(spark, source, vocabulary, STANDARD, M, EXTRA)
    jobs.two_pass_apply(spark, source, vocabulary, target, STANDARD, M, EXTRA, ROW)
    back = read_tsv(spark, target, STANDARD, EXTRA)
    return back.select(
        *ROW,
        F.col("col_0").cast("int").alias("col_0"),
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in DENSE],
        *[F.col(c).cast("bigint").alias(c) for c in SPARSE],
    )


@query("tsv_two_pass_large", encoded_sql("frequency", M_LARGE, "coalesce(idx, -1)"))
def tsv_two_pass_large(spark, sf):
    """Values below 2**29, no broadcast vocabulary and no row key."""
    source = text_log(spark, sf)
    vocabulary, target = new_path(spark, "pass-1"), new_path(spark, "pass-2")
    jobs.two_pass_vocabulary(spark, source, vocabulary, STANDARD, M_LARGE, EXTRA)
    jobs.two_pass_apply(
        spark, source, vocabulary, target, STANDARD, M_LARGE, EXTRA, ROW, broadcast_rows=0
    )
    back = read_tsv(spark, target, STANDARD, EXTRA)
    return back.select(
        *ROW,
        F.col("col_0").cast("int").alias("col_0"),
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in DENSE],
        *[F.col(c).cast("bigint").alias(c) for c in SPARSE],
    )


@query("parquet_two_pass", encoded_sql("frequency", unseen="coalesce(idx, -1)"))
def parquet_two_pass(spark, sf):
    source = new_path(spark, "clicklog")
    clicklog(spark, sf).write.parquet(source)
    log = spark.read.parquet(source)
    vocabulary, target = new_path(spark, "pass-1"), new_path(spark, "pass-2")
    jobs.two_pass_vocabulary(spark, log, vocabulary, STANDARD, M)
    jobs.two_pass_apply(spark, log, vocabulary, target, STANDARD, M, keep=ROW, kind="parquet")
    return rounded(spark.read.parquet(target), DENSE)


@query("preprocess_with_vocab_large", encoded_sql("frequency", M_LARGE))
def preprocess_with_vocab_large(spark, sf):
    """Values below 2**29, no broadcast vocabulary and no row key."""
    out = jobs.preprocess_with_vocabulary(
        clicklog(spark, sf), STANDARD, M_LARGE, ROW, broadcast_rows=0
    )
    return rounded(out, DENSE)


DAYS = (
    ", days AS (SELECT * REPLACE (cast(ntile(24) over (order by row_id) - 1 as integer) AS split) FROM f1)"
    f", kept AS (SELECT * FROM days WHERE NOT (col_0 = 0 AND cast({draw_sql(8, 'row_id')} as double) "
    "/ 1152921504606846976.0 < 0.25))"
)


def day_sql(slot: str) -> str:
    body = encoded_sql("first_seen", rows="kept", more=DAYS)
    head, tail = body.split(" SELECT d.*, e.*", 1)
    return f"{head} SELECT *, {slot} AS slot FROM (SELECT d.*, e.*{tail})"


LAST = SPLITS - 1


@query("day_job", day_sql("row_number() over (partition by split order by row_id) - 1"))
def day_job(spark, sf):
    out = jobs.prepare_days(
        clicklog(spark, sf).drop("split"), STANDARD, "row_id", SPLITS, M, 0.25, "none", seed=8
    )
    return rounded(out, DENSE)


@query(
    "day_job_shuffled",
    day_sql(
        f"row_number() over (partition by split order by case when split <> {LAST} then "
        f"{draw_sql(8, 'row_id')} end, row_id) - 1"
    ),
)
def day_job_shuffled(spark, sf):
    out = jobs.prepare_days(
        clicklog(spark, sf).drop("split"), STANDARD, "row_id", SPLITS, M, 0.25, "day", seed=8
    )
    return rounded(out, DENSE)


def _total_sql() -> str:
    """One random order of all days but the last, cut at the sizes of the days."""
    body = encoded_sql("first_seen", rows="kept", more=DAYS)
    head, tail = body.split(" SELECT d.*, e.*", 1)
    return (
        f"{head} SELECT x.* EXCLUDE (pos) REPLACE (coalesce(b.split, x.split) AS split), "
        "cast(pos - coalesce(b.off, 0) as bigint) AS slot FROM (SELECT *, row_number() over "
        f"(partition by split = {LAST} order by case when split <> {LAST} then {draw_sql(8, 'row_id')} end, "
        f"row_id) - 1 AS pos FROM (SELECT d.*, e.*{tail})) x LEFT JOIN (SELECT split, n, sum(n) over "
        f"(order by split) - n AS off FROM (SELECT split, count(*) AS n FROM kept WHERE split <> {LAST} "
        f"GROUP BY split)) b ON x.split <> {LAST} AND pos >= b.off AND pos < b.off + b.n"
    )


@query("day_job_total", _total_sql())
def day_job_total(spark, sf):
    out = jobs.prepare_days(
        clicklog(spark, sf).drop("split"), STANDARD, "row_id", SPLITS, M, 0.25, "total", seed=8
    )
    return rounded(out, DENSE)


FILES = 4


@query(
    "day_job_by_file",
    day_sql("row_number() over (partition by split order by row_id) - 1").replace(
        DAYS.split(", kept AS")[0],
        f", days AS (SELECT * REPLACE (cast(split % {FILES} as integer) AS split) FROM f1)",
    ),
)
def day_job_by_file(spark, sf):
    """One folder of files per day; earlier calls with other arguments leave their stages behind."""
    path, folder = new_path(spark, "log"), new_path(spark, "days")
    for k in range(FILES):
        clicklog(spark, sf).where(F.col("split") % FILES == k).drop("split").write.parquet(f"{path}/day_{k}")
    log = with_split_from_file(spark.read.parquet(f"{path}/day_*"), r"day_(\d+)")
    for modulus, rate, randomize, seed in ((64, 0.5, "day", 3), (M, 0.25, "total", 8), (M, 0.25, "none", 8)):
        out = jobs.prepare_days(
            log, STANDARD, "row_id", FILES, modulus, rate, randomize, seed=seed, split="split", folder=folder
        )
    return rounded(out, DENSE)


@query(
    "utf8_to_parquet",
    with_f1(
        f"SELECT row_id, col_0, {listed(DENSE, lambda c: f'cast({fill(c)} as integer)')}, "
        + listed(SPARSE, lambda c: f"lpad({fill(c)}, 8, '0')") + " FROM f1"
    ),
)
def utf8_to_parquet(spark, sf):
    path = new_path(spark, "typed")
    jobs.typed_parquet(spark, text_log(spark, sf), path, STANDARD, EXTRA, ["row_id"])
    return spark.read.parquet(path)


MATRIX = FeatureSpec.matrix_names()
DASHED = FeatureSpec.dashed_names()


@query(
    "rename_profile",
    with_f1(
        "SELECT row_id, " + ", ".join(f"{a} AS {b}" for a, b in zip(STANDARD.columns, MATRIX.columns))
        + " FROM f1"
    ),
)
def rename_profile(spark, sf):
    """To the dashed names and on to the matrix names."""
    dashed = STANDARD.rename_to(clicklog(spark, sf).drop("split"), DASHED)
    return DASHED.rename_to(dashed, MATRIX)


@query(
    "operator_bench",
    "SELECT u.operator, 26 AS columns, count(*) AS n, true AS timed FROM events, "
    "(VALUES ('hex_to_int'), ('hex_mod'), ('read')) u(operator) GROUP BY u.operator",
)
def operator_bench(spark, sf):
    operators = {
        "read": lambda c: c,
        "hex_to_int": lambda c: S.hex_to_int(D.fill_missing(c)),
        "hex_mod": lambda c: S.hex_mod(D.fill_missing(c), M),
    }
    timed = timing.time_operators(clicklog(spark, sf), operators, SPARSE)
    return timed.select("operator", "columns", "n", (F.col("seconds") > 0).alias("timed"))


@query("scan_bench", "SELECT 1::bigint AS files, count(*) AS n, true AS timed FROM lineitem")
def scan_bench(spark, sf):
    result = timing.time_scan(table(spark, sf, "lineitem"))
    timed = (F.col("gb_per_second") > 0) & (F.col("rows_per_second") > 0)
    return result.select("files", "n", timed.alias("timed"))
