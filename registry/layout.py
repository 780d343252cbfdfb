"""Counts, checks, positions, splits, shuffles and column assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions.dense import fill_missing, neg_to_zero
from clickloom.functions.permute import PRIME, round_keys
from clickloom.operators import combine, numbering, splits, stats
from clickloom.operators.filters import subsample_negatives
from clickloom.operators.vocabulary import distinct_values
from clickloom.session import new_path
from clickloom.spec import STANDARD
from registry.base import (
    DENSE, ROW, SPARSE, SPLITS, cells_sql, clicklog, draw_sql, fill, listed, query, reduced,
    rounded, table, with_f1,
)

LAST = SPLITS - 1


@query(
    "rows_per_split",
    with_f1(
        "SELECT split, count(*) AS n FROM f1 GROUP BY split "
        "UNION ALL SELECT NULL, count(*) FROM f1"
    ),
)
def rows_per_split(spark, sf):
    return stats.rows_and_total(clicklog(spark, sf), "split")


@query(
    "label_counts_per_split",
    with_f1(
        "SELECT split, count(case when col_0 = 1 then 1 end) AS positives, "
        "count(case when col_0 = 0 then 1 end) AS negatives FROM f1 GROUP BY split"
    ),
)
def label_counts_per_split(spark, sf):
    return stats.label_counts_per_split(clicklog(spark, sf), "split", "col_0")


@query("global_count", "SELECT count(*) AS n FROM events")
def global_count(spark, sf):
    return stats.global_count(clicklog(spark, sf))


OFFSETS = (
    "SELECT split, n, cast(coalesce(sum(n) over (order by split rows between unbounded "
    "preceding and 1 preceding), 0) as bigint) AS \"offset\" FROM "
    "(SELECT split, count(*) AS n FROM f1 GROUP BY split)"
)


@query("split_offsets", with_f1(OFFSETS))
def split_offsets(spark, sf):
    return splits.split_offsets(splits.rows_per_split(clicklog(spark, sf), "split"))


KEPT = (
    f"NOT (col_0 = 0 AND cast({draw_sql(5, 'row_id')} as double) / 1152921504606846976.0 < 0.1)"
)


@query(
    "check_split_sizes",
    with_f1(
        "SELECT split, expected, found FROM (SELECT split, count(*) AS expected, "
        f"count(case when {KEPT} then 1 end) AS found FROM f1 GROUP BY split) "
        "WHERE expected <> found"
    ),
)
def check_split_sizes(spark, sf):
    before = clicklog(spark, sf)
    after = subsample_negatives(before, "col_0", 0.1, "row_id", seed=5)
    return stats.check_split_sizes(before, after, "split")


def _typed(c: str) -> str:
    return f"cast({fill(c)} as double)"


@query(
    "check_reorder_norm",
    with_f1(
        "SELECT split, round(sqrt(sum("
        + " + ".join(f"pow({_typed(c)} - greatest({_typed(c)}, 0), 2)" for c in DENSE)
        + ")), 4) AS norm FROM f1 GROUP BY split"
    ),
)
def check_reorder_norm(spark, sf):
    raw = clicklog(spark, sf).select(
        *ROW, *[fill_missing(c).cast("double").alias(c) for c in DENSE]
    )
    clipped = raw.select(*ROW, *[neg_to_zero(F.col(c)).alias(c) for c in DENSE])
    return rounded(stats.reorder_norm(raw, clipped, "split", "row_id", DENSE), ["norm"], 4)


@query(
    "file_inventory",
    "SELECT 'events.parquet' AS file, count(*) AS n, true AS has_bytes FROM events UNION ALL "
    "SELECT 'lineitem.parquet', count(*), true FROM lineitem",
)
def file_inventory(spark, sf):
    files = [stats.file_inventory(table(spark, sf, t)) for t in ("events", "lineitem")]
    return combine.union_rows(files).select("file", "n", (F.col("bytes") > 0).alias("has_bytes"))


def _manifest_sql() -> str:
    shape = [("row_id", "bigint", 8), ("split", "int", 4), ("col_0", "int", 4)]
    shape += [(c, "double", 8) for c in DENSE]
    parts, offset = [], 0
    for name, kind, width in shape:
        parts.append(
            f"SELECT count(*) AS num_rows, '{name}' AS name, '{kind}' AS dtype, "
            f"count(*) * {offset} AS \"offset\", count(*) * {width} AS size FROM events"
        )
        offset += width
    return " UNION ALL ".join(parts)


@query("column_manifest", _manifest_sql())
def column_manifest(spark, sf):
    typed = clicklog(spark, sf).select(
        *ROW, "col_0", *[fill_missing(c).cast("double").alias(c) for c in DENSE]
    )
    return stats.column_manifest(typed)


# --- positions and splits ---------------------------------------------------


@query(
    "row_position",
    "SELECT event_id, row_number() over (order by value, event_id) - 1 AS pos FROM events",
)
def row_position(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return numbering.number_rows(events, [F.col("value"), F.col("event_id")]).drop("value")


@query(
    "row_position_in_files",
    "SELECT event_id, user_id, row_number() over (order by event_id) - 1 AS pos FROM events",
)
def row_position_in_files(spark, sf):
    """The table lies in its file in order of ``event_id``."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    return numbering.positions_in_files(events)


@query(
    "split_contiguous",
    "SELECT o_orderkey, cast(ntile(24) over (order by o_orderkey) - 1 as integer) AS split, "
    "cast(ntile(7) over (order by o_orderkey) - 1 as integer) AS week FROM orders",
)
def split_contiguous(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    days = splits.split_contiguous(orders, "o_orderkey", SPLITS)
    return splits.split_contiguous(days, "o_orderkey", 7, name="week")


@query("split_by_file", with_f1("SELECT row_id, split AS day FROM f1"))
def split_by_file(spark, sf):
    from clickloom.sources.clicklog import read_glob, with_split_from_file

    base = new_path(spark, "days")
    rows = clicklog(spark, sf).select("row_id", F.col("split").alias("day"))
    rows.write.partitionBy("day").parquet(base)
    files = read_glob(spark, base).select("row_id")
    return with_split_from_file(files, r"day=(\d+)", "day")


@query(
    "train_val_test",
    with_f1(
        f"SELECT row_id, split, case when split <> {LAST} then 'train' "
        "when ntile(2) over (partition by split order by row_id) = 1 then 'test' "
        "else 'val' end AS role FROM f1"
    ),
)
def train_val_test(spark, sf):
    return splits.train_val_test(clicklog(spark, sf).select(*ROW), "split", "row_id", LAST)


@query(
    "shuffle_within_split",
    with_f1(
        "SELECT row_id, split, row_number() over (partition by split order by "
        f"case when split <> {LAST} then {draw_sql(3, 'row_id')} end, row_id) - 1 AS slot FROM f1"
    ),
)
def shuffle_within_split(spark, sf):
    rows = clicklog(spark, sf).select(*ROW)
    return splits.shuffle_within_split(rows, "split", "row_id", seed=3, pinned=LAST)


@query(
    "shuffle_across_splits",
    with_f1(
        "SELECT row_id, split, row_number() over (order by "
        f"{draw_sql(4, 'row_id')}, row_id) - 1 AS slot FROM f1 WHERE split <> {LAST}"
    ),
)
def shuffle_across_splits(spark, sf):
    train = clicklog(spark, sf).select(*ROW).where(F.col("split") != LAST)
    return splits.shuffle_rows(train, "row_id", seed=4)


@query(
    "shuffle_two_pass",
    with_f1(
        "SELECT p.row_id, p.split, case when p.pin then p.split else o.split end AS bucket, "
        "case when p.pin then p.pos else p.pos - o.\"offset\" end AS slot FROM pos p "
        "LEFT JOIN off o ON NOT p.pin AND p.pos >= o.\"offset\" AND p.pos < o.\"offset\" + o.n "
        f"AND o.split <> {LAST}",
        more=f", off AS ({OFFSETS}), pos AS (SELECT row_id, split, split = {LAST} AS pin, "
        f"row_number() over (partition by split = {LAST} order by case when split <> {LAST} "
        f"then {draw_sql(6, 'row_id')} end, row_id) - 1 AS pos FROM f1)",
    ),
)
def shuffle_two_pass(spark, sf):
    rows = clicklog(spark, sf).select(*ROW)
    return splits.shuffle_into_splits(rows, "split", "row_id", last=LAST, seed=6)


def permute_sql(at: str, n: str, seed: int) -> str:
    """The permutation by formula; a list of four numbers is the state of its rounds."""
    a = f"greatest(ceil(sqrt({n}::double)), 1)::bigint"
    b = f"greatest(ceil({n}::double / ({a})), 1)::bigint"
    keys = ", ".join(f"[{k}, {x}, {y}, {z}]" for k, (x, y, z) in enumerate(round_keys(seed)))

    def mixed(x: str) -> str:
        y = f"(({x} + k[2]) % {PRIME})"
        return f"(({y} * {y} % {PRIME} * k[3] + k[4]) % {PRIME})"

    def network(v: str) -> str:
        rounds = (
            f"list_reduce([[{v} // ({b}), {v} % ({b}), 0, 0]::bigint[]] || [{keys}]::bigint[][], lambda s, k: CASE WHEN "
            f"k[1] % 2 = 0 THEN [(s[1] + {mixed('s[2]')}) % ({a}), s[2], 0, 0]::bigint[] "
            f"ELSE [s[1], (s[2] + {mixed('s[1]')}) % ({b}), 0, 0]::bigint[] END)"
        )
        return f"list_transform([{rounds}], lambda s: s[1] * ({b}) + s[2])[1]"

    return (
        f"list_reduce([{network(at)}] || range(({a}) * ({b}) - {n}), "
        f"lambda v, i: CASE WHEN v < {n} THEN v ELSE {network('v')} END)"
    )


PLACED = (
    ", placed AS (SELECT row_id, ntile(24) over (order by row_id) - 1 AS split, "
    "row_number() over (order by row_id) - 1 AS pos FROM f1), "
    "sized AS (SELECT split, count(*) AS n, min(pos) AS start FROM placed GROUP BY ALL)"
)


def ordered_files(spark, sf):
    """Row ids in three files, in order of file and row."""
    path = new_path(spark, "ordered")
    rows = clicklog(spark, sf).select("row_id")
    rows.repartitionByRange(3, "row_id").sortWithinPartitions("row_id").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "shuffle_within_files",
    with_f1(
        "SELECT row_id, cast(split as integer) AS split, cast(split as integer) AS bucket, "
        f"case when split = {LAST} then pos - start else {permute_sql('(pos - start)', 'n', 3)} end AS slot "
        "FROM placed JOIN sized USING (split)",
        more=PLACED,
    ),
)
def shuffle_within_files(spark, sf):
    """New places inside contiguous splits, by formula from file positions."""
    return splits.shuffle_files(ordered_files(spark, sf), SPLITS, seed=3, last=LAST)


@query(
    "shuffle_across_files",
    with_f1(
        "SELECT row_id, cast(m.split as integer) AS split, cast(s.split as integer) AS bucket, "
        "cast(place - s.start as bigint) AS slot FROM (SELECT row_id, split, case when split = "
        f"{LAST} then pos else {permute_sql('pos', 'o.n', 6)} end AS place FROM placed, "
        f"(SELECT count(*) AS n FROM placed WHERE split <> {LAST}) o) m "
        "JOIN sized s ON place >= s.start AND place < s.start + s.n",
        more=PLACED,
    ),
)
def shuffle_across_files(spark, sf):
    """Rows dealt to splits of the same sizes, by formula from file positions."""
    return splits.shuffle_files(ordered_files(spark, sf), SPLITS, seed=6, across=True, last=LAST)


@query(
    "footer_counts",
    with_f1("SELECT split, count(*) AS n FROM f1 GROUP BY split UNION ALL SELECT NULL, count(*) FROM f1"),
)
def footer_counts(spark, sf):
    """Rows per split and in all, from the footers of files by split."""
    path = new_path(spark, "by-split")
    clicklog(spark, sf).select(*ROW).write.partitionBy("split").parquet(path)
    total = stats.footer_counts(spark, path).select(F.lit(None).cast("int").alias("split"), "n")
    return stats.footer_counts(spark, path, ["split"]).unionByName(total)


@query(
    "sort_values",
    with_f1(
        "SELECT feature, value, row_number() over (partition by feature order by value) - 1 "
        "AS rank FROM (SELECT DISTINCT feature, value FROM cells)",
        more=f", cells AS ({cells_sql()})",
    ),
)
def sort_values(spark, sf):
    values = distinct_values(reduced(spark, sf), SPARSE)
    return numbering.number_rows(values, [F.col("value")], within=["feature"], name="rank")


@query(
    "head_n",
    with_f1("SELECT row_id, split, col_0, col_1, col_14 FROM f1 ORDER BY row_id LIMIT 100"),
)
def head_n(spark, sf):
    rows = clicklog(spark, sf).select(*ROW, "col_0", "col_1", "col_14")
    return splits.head_n(rows, "row_id", 100)


@query(
    "sample_fixed",
    with_f1(f"SELECT row_id, col_14 FROM f1 ORDER BY {draw_sql(9, 'row_id')}, row_id LIMIT 10"),
)
def sample_fixed(spark, sf):
    return splits.sample_fixed(clicklog(spark, sf).select("row_id", "col_14"), "row_id", 10, seed=9)


# --- assembly ---------------------------------------------------------------

EVERYTHING = with_f1(f"SELECT row_id, split, {', '.join(STANDARD.columns)} FROM f1")


@query("union_splits", EVERYTHING)
def union_splits(spark, sf):
    path = new_path(spark, "splits")
    clicklog(spark, sf).write.partitionBy("split").parquet(path)
    parts = [spark.read.option("basePath", path).parquet(f"{path}/split={k}") for k in range(SPLITS)]
    return combine.union_rows(parts)


@query("concat_tables", EVERYTHING)
def concat_tables(spark, sf):
    from clickloom.sources.clicklog import read_rows

    paths = [new_path(spark, f"table-{k}") for k in range(2)]
    f1 = clicklog(spark, sf)
    for k, path in enumerate(paths):
        f1.where(F.col("split") % 2 == k).write.parquet(path)
    return read_rows(spark, paths)


@query("zip_columns", with_f1(f"SELECT row_id, col_0, {listed([*DENSE, *SPARSE], str)} FROM f1"))
def zip_columns(spark, sf):
    """Three tables of their own, as their writers left them."""
    f1 = clicklog(spark, sf)
    path = new_path(spark, "column-parts")
    for k, part in enumerate([["col_0"], DENSE, SPARSE]):
        f1.select("row_id", *part).write.parquet(f"{path}/{k}")
    return combine.zip_columns([spark.read.parquet(f"{path}/{k}") for k in range(3)], "row_id")
