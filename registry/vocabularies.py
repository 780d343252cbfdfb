"""Vocabulary operators and the jobs that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import bitmaps as B
from clickloom.operators import vocabulary as V
from clickloom.session import new_path
from clickloom.sinks import files as sinks
from registry.base import (
    M, M_LARGE, ROW, SPARSE, cells_sql, hexmod, listed, query, reduced, table, with_f1,
)


def cells_cte(m: int = M) -> str:
    return f", cells AS ({cells_sql(m)})"


ORDERS = {
    "frequency": "cnt desc, cast(value as varchar) desc",
    "sorted": "value",
    "first_seen": "first",
}


def vocab_cte(order: str, src: str = "cells", name: str = "voc", where: str = "true") -> str:
    return (
        f", {name}_counts AS (SELECT feature, value, count(*) AS cnt, min(row_id) AS first "
        f"FROM {src} GROUP BY ALL), {name} AS (SELECT feature, value, "
        f"row_number() over (partition by feature order by {ORDERS[order]}) - 1 AS idx, cnt "
        f"FROM {name}_counts WHERE {where})"
    )


def wide(unseen: str = "idx", source: str = "cells") -> str:
    """Ids of all cells turned back into one row per row id."""
    picks = ", ".join(
        f"max(case when feature = '{c}' then {unseen} end) AS {c}" for c in SPARSE
    )
    return (
        f"SELECT row_id, split, {picks} FROM "
        f"(SELECT x.*, v.idx FROM {source} x LEFT JOIN voc v USING (feature, value)) GROUP BY ALL"
    )


def vocab(df):
    return df.select("feature", "value", "idx", "cnt")


@query("vocab_distinct", with_f1("SELECT DISTINCT feature, value FROM cells", more=cells_cte()))
def vocab_distinct(spark, sf):
    return V.distinct_values(reduced(spark, sf), SPARSE)


@query(
    "vocab_merge",
    with_f1(
        "SELECT DISTINCT feature, value FROM cells WHERE split < 8 "
        "UNION SELECT feature, value FROM cells WHERE split >= 8",
        more=cells_cte(),
    ),
)
def vocab_merge(spark, sf):
    rows = reduced(spark, sf)
    first = V.distinct_values(rows.where("split < 8"), SPARSE)
    rest = V.distinct_values(rows.where("split >= 8"), SPARSE)
    return V.merge_values(first, rest)


def _vocab_sql(order: str, m: int = M, where: str = "true") -> str:
    return with_f1(
        "SELECT feature, value, idx, cnt FROM voc",
        more=cells_cte(m) + vocab_cte(order, where=where),
    )


@query("vocab_first_seen", _vocab_sql("first_seen"))
def vocab_first_seen(spark, sf):
    return vocab(V.fit_vocabulary(reduced(spark, sf), SPARSE, "first_seen", row_key="row_id"))


@query("vocab_sorted", _vocab_sql("sorted"))
def vocab_sorted(spark, sf):
    return vocab(V.fit_vocabulary(reduced(spark, sf), SPARSE, "sorted"))


@query(
    "vocab_bitmap_sorted",
    with_f1("SELECT feature, value, idx FROM voc", more=cells_cte(M_LARGE) + vocab_cte("sorted")),
)
def vocab_bitmap_sorted(spark, sf):
    """Values below 2**29, numbered by the ranks of their bits."""
    found = B.value_bitmaps(reduced(spark, sf, M_LARGE), SPARSE, M_LARGE)
    return B.vocabulary_of(B.rank_bitmaps(found))


@query(
    "vocab_bitmap_days",
    with_f1(
        "SELECT feature, count(DISTINCT value) AS cardinality FROM cells GROUP BY ALL", more=cells_cte(M_LARGE)
    ),
)
def vocab_bitmap_days(spark, sf):
    """Bitmaps of three groups of days, merged."""
    rows = reduced(spark, sf, M_LARGE)
    days = [B.value_bitmaps(rows.where(F.col("split") % 3 == k), SPARSE, M_LARGE) for k in range(3)]
    return B.cardinality(B.merge_bitmaps(*days))


@query(
    "vocab_bitmap_apply",
    with_f1(
        wide("coalesce(idx, -1)"),
        more=cells_cte(M_LARGE) + ", part AS (SELECT * FROM cells WHERE split < 4)" + vocab_cte("sorted", "part"),
    ),
)
def vocab_bitmap_apply(spark, sf):
    rows = reduced(spark, sf, M_LARGE)
    ranked = B.rank_bitmaps(B.value_bitmaps(rows.where("split < 4"), SPARSE, M_LARGE))
    return B.apply_bitmaps(rows, SPARSE, ranked, oov_id=-1, row_key="row_id")


@query("vocab_by_frequency", _vocab_sql("frequency"))
def vocab_by_frequency(spark, sf):
    return vocab(V.fit_vocabulary(reduced(spark, sf), SPARSE, "frequency"))


@query("vocab_by_frequency_large", _vocab_sql("frequency", M_LARGE))
def vocab_by_frequency_large(spark, sf):
    """The way for vocabularies of any size: numbered by ranges."""
    counts, rows = V.store_counted(V.value_counts(reduced(spark, sf, M_LARGE), SPARSE), "value-counts")
    order = [F.col("cnt").desc(), F.col("value").cast("string").desc()]
    return vocab(V.number_rows(counts, order, within=["feature"], name="idx", rows=rows, plain_rows=0))


@query(
    "vocab_freq_threshold",
    with_f1(
        "SELECT feature, value, idx + 3 AS idx, cnt FROM voc",
        more=cells_cte() + vocab_cte("frequency", where="cnt >= 5"),
    ),
)
def vocab_freq_threshold(spark, sf):
    fitted = V.fit_vocabulary(reduced(spark, sf), SPARSE, "frequency", min_count=5, first_id=3)
    return vocab(fitted)


@query(
    "vocab_freq_threshold_apply",
    with_f1(
        wide("coalesce(idx + 3, 2)"),
        more=cells_cte() + vocab_cte("frequency", where="cnt >= 5"),
    ),
)
def vocab_freq_threshold_apply(spark, sf):
    rows = reduced(spark, sf)
    fitted = V.fit_vocabulary(rows, SPARSE, "frequency", min_count=5, first_id=3)
    return V.apply_vocabulary(rows, SPARSE, fitted, unseen="oov", oov_id=2)


def _identity(c: str) -> str:
    return f"case when {hexmod(c, M_LARGE)} < {M} then {hexmod(c, M_LARGE)} end"


@query("vocab_identity", with_f1(f"SELECT row_id, split, {listed(SPARSE, _identity)} FROM f1"))
def vocab_identity(spark, sf):
    rows = reduced(spark, sf, M_LARGE)
    return rows.select(*ROW, *[V.apply_identity(F.col(c), M).alias(c) for c in SPARSE])


@query(
    "vocab_extend",
    with_f1(
        "SELECT feature, value, idx, cnt FROM voc UNION ALL "
        "SELECT n.feature, n.value, l.last + n.idx + 1, n.cnt FROM new n "
        "JOIN (SELECT feature, max(idx) AS last FROM voc GROUP BY ALL) l USING (feature)",
        more=cells_cte()
        + ", old_cells AS (SELECT * FROM cells WHERE split < 8)"
        + vocab_cte("first_seen", "old_cells")
        + ", new_cells AS (SELECT * FROM cells c WHERE split >= 8 AND NOT EXISTS "
        "(SELECT 1 FROM voc v WHERE v.feature = c.feature AND v.value = c.value))"
        + vocab_cte("first_seen", "new_cells", "new"),
    ),
)
def vocab_extend(spark, sf):
    rows = reduced(spark, sf)
    old = V.fit_vocabulary(rows.where("split < 8"), SPARSE, "first_seen", row_key="row_id")
    return vocab(V.extend_vocabulary(old, rows.where("split >= 8"), SPARSE, "row_id"))


@query(
    "vocab_cardinality",
    with_f1(
        "SELECT feature, count(distinct value) AS cardinality FROM cells GROUP BY ALL",
        more=cells_cte(),
    ),
)
def vocab_cardinality(spark, sf):
    return V.cardinality(reduced(spark, sf), SPARSE)


@query("vocab_apply_strict", with_f1(wide(), more=cells_cte() + vocab_cte("first_seen")))
def vocab_apply_strict(spark, sf):
    rows = reduced(spark, sf)
    fitted = V.fit_vocabulary(rows, SPARSE, "first_seen", row_key="row_id")
    return V.apply_vocabulary(rows, SPARSE, fitted, unseen="error")


PARTIAL = cells_cte() + ", part AS (SELECT * FROM cells WHERE split < 4)" + vocab_cte("sorted", "part")


def _partial(spark, sf):
    rows = reduced(spark, sf)
    return rows, V.fit_vocabulary(rows.where("split < 4"), SPARSE, "sorted")


@query("vocab_apply_null", with_f1(wide(), more=PARTIAL))
def vocab_apply_null(spark, sf):
    rows, fitted = _partial(spark, sf)
    return V.apply_vocabulary(rows, SPARSE, fitted, unseen="null")


@query("vocab_apply_oov", with_f1(wide("coalesce(idx, -1)"), more=PARTIAL))
def vocab_apply_oov(spark, sf):
    rows, fitted = _partial(spark, sf)
    return V.apply_vocabulary(rows, SPARSE, fitted, unseen="oov")


@query(
    "vocab_apply_large",
    with_f1(
        wide("coalesce(idx, -1)"),
        more=cells_cte(M_LARGE) + ", part AS (SELECT * FROM cells WHERE split < 4)"
        + vocab_cte("sorted", "part"),
    ),
)
def vocab_apply_large(spark, sf):
    """The way for vocabularies too large to broadcast."""
    rows = reduced(spark, sf, M_LARGE)
    fitted = V.fit_vocabulary(rows.where("split < 4"), SPARSE, "sorted")
    return V.apply_vocabulary(
        rows, SPARSE, fitted, unseen="oov", row_key="row_id", broadcast_rows=0
    )


@query("vocab_fit_transform", with_f1(wide(), more=cells_cte() + vocab_cte("frequency")))
def vocab_fit_transform(spark, sf):
    rows = reduced(spark, sf)
    return V.Categorify(SPARSE).fit(rows).transform(rows)


@query("fit_transform_fn", with_f1(wide(), more=cells_cte() + vocab_cte("sorted")))
def fit_transform_fn(spark, sf):
    from pyspark.ml import Pipeline

    rows = reduced(spark, sf)
    encoder = V.Categorify(SPARSE, order="sorted", unseen="error")
    return Pipeline(stages=[encoder]).fit(rows).transform(rows)


@query("vocab_load", with_f1(wide("coalesce(idx, -1)"), more=PARTIAL))
def vocab_load(spark, sf):
    rows, fitted = _partial(spark, sf)
    path = new_path(spark, "kept-vocabulary")
    sinks.write_vocabulary(fitted, path)
    loaded = sinks.read_vocabulary(spark, path)
    return V.CategorifyModel(loaded, SPARSE).transform(rows)


@query(
    "write_vocab",
    with_f1(
        "SELECT feature, value, idx, cnt, cast(value as varchar) AS line FROM voc",
        more=cells_cte() + vocab_cte("frequency"),
    ),
)
def write_vocab(spark, sf):
    """All three formats, read back and matched to each other."""
    fitted = V.fit_vocabulary(reduced(spark, sf), SPARSE)
    paths = {kind: new_path(spark, f"vocabulary-{kind}") for kind in ("parquet", "json", "text")}
    for kind, path in paths.items():
        sinks.write_vocabulary(fitted, path, kind)
    table = sinks.read_vocabulary(spark, paths["parquet"])
    entries = spark.read.schema("value BIGINT, idx BIGINT, cnt BIGINT, feature STRING").json(
        paths["json"]
    )
    lines = spark.read.text(paths["text"]).select("feature", F.col("value").alias("line"))
    return (
        table.join(entries, ["feature", "value", "idx", "cnt"])
        .join(lines, (table.feature == lines.feature) & (F.col("value").cast("string") == F.col("line")))
        .select(table.feature, "value", "idx", "cnt", "line")
    )


@query(
    "vocab_apply_batch_files",
    with_f1(
        "SELECT file, feature, row_id, coalesce(idx, -1) AS idx FROM "
        "(SELECT x.*, split % 4 AS file, v.idx FROM cells x LEFT JOIN voc v USING (feature, value))",
        more=PARTIAL,
    ),
)
def vocab_apply_batch_files(spark, sf):
    source, target = new_path(spark, "batch-in"), new_path(spark, "batch-out")
    rows, fitted = _partial(spark, sf)
    rows.withColumn("file", F.col("split") % 4).write.partitionBy("file").parquet(source)
    V.apply_to_files(spark.read.parquet(source), SPARSE, fitted, target, ["file", "row_id"])
    return spark.read.parquet(target).select("file", "feature", "row_id", "idx")


@query(
    "vocab_apply_batch_files_large",
    with_f1(
        "SELECT file, feature, row_id, coalesce(idx, -1) AS idx FROM "
        "(SELECT x.*, split % 4 AS file, v.idx FROM cells x LEFT JOIN voc v USING (feature, value))",
        more=cells_cte(M_LARGE) + ", part AS (SELECT * FROM cells WHERE split < 4)"
        + vocab_cte("sorted", "part"),
    ),
)
def vocab_apply_batch_files_large(spark, sf):
    """Values below 2**29, nothing broadcast but heavy keys."""
    source, target = new_path(spark, "batch-in"), new_path(spark, "batch-out")
    rows = reduced(spark, sf, M_LARGE)
    fitted = V.fit_vocabulary(rows.where("split < 4"), SPARSE, "sorted")
    rows.withColumn("file", F.col("split") % 4).write.partitionBy("file").parquet(source)
    V.apply_to_files(
        spark.read.parquet(source), SPARSE, fitted, target, ["file", "row_id"], broadcast_rows=0
    )
    return spark.read.parquet(target).select("file", "feature", "row_id", "idx")


@query(
    "vocab_load_text",
    "WITH counted AS (SELECT event_type AS value, count(*) AS cnt FROM events WHERE event_type IS NOT NULL "
    "GROUP BY 1), voc AS (SELECT value, row_number() over (order by cnt desc, value desc) - 1 AS idx "
    "FROM counted) SELECT event_id, idx AS event_type FROM events e LEFT JOIN voc v ON e.event_type = v.value",
)
def vocab_load_text(spark, sf):
    """A vocabulary of text values, kept and read back."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    path = new_path(spark, "kept-vocabulary")
    sinks.write_vocabulary(V.fit_vocabulary(events, ["event_type"]), path)
    loaded = sinks.read_vocabulary(spark, path)
    return V.CategorifyModel(loaded, ["event_type"], "null").transform(events)
