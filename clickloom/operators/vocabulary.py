"""Per-column vocabularies: learn, merge, extend, keep and apply.

A vocabulary is a long table ``(feature, value, idx, cnt)``, unique on
``(feature, value)`` and on ``(feature, idx)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clickloom.functions.rows import quoted
from clickloom.operators.lookup import skewed_lookup, store_with_heavy
from clickloom.operators.numbering import lead_of, number_rows
from clickloom.session import shuffle_parts, store, store_counted

# Rows of all vocabularies broadcast in one query; about 150 MB per executor.
# Text values count one more row for every 64 bytes.
BROADCAST_ROWS = 2_000_000
TEXT_BYTES_PER_ROW = 64
COUNTED_ROWS = 1 << 18


def cells(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per cell ``(*keys, feature, value)``; NULL cells are dropped."""
    columns = [*keys, *features]
    return (
        df.select(*[quoted(c) for c in columns])
        .unpivot([quoted(k) for k in keys], [quoted(f) for f in features], "feature", "value")
        .where(F.col("value").isNotNull())
    )


def distinct_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return cells(df, features).distinct()


def merge_values(*parts: DataFrame) -> DataFrame:
    """Union of several sets of ``(feature, value)``."""
    merged = parts[0].select("feature", "value")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("feature", "value"))
    return merged.distinct()


def value_counts(
    df: DataFrame, features: Sequence[str], row_key: str | None = None
) -> DataFrame:
    """Count of every value, with the least row key where it appears."""
    if row_key is None and _integers(df, features):
        return _integer_counts(df, features)
    measures = [F.count(F.lit(1)).alias("cnt")]
    if row_key:
        measures.append(F.min(row_key).alias("first"))
    long = cells(df, features, [row_key] if row_key else [])
    return long.groupBy("feature", "value").agg(*measures)


def _integers(df: DataFrame, features: Sequence[str]) -> bool:
    return all(isinstance(df.schema[f].dataType, T.IntegralType) for f in features)


def _integer_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``value_counts`` of integer columns: tasks count runs of ``COUNTED_ROWS`` rows column by column.

    A task holds one run; what it has counted leaves at once, so values of any number fit.
    """
    names = list(features)

    def counted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        for name, column in zip(names, table.columns):
            cells_of = column.drop_null().cast(pa.int64()).to_numpy()
            if not len(cells_of):
                continue
            low, high = int(cells_of.min()), int(cells_of.max())
            if high - low < 4 * len(cells_of):
                counts = np.bincount(cells_of - low)
                values = np.flatnonzero(counts)
                values, counts = values + low, counts[values]
            else:
                values, counts = np.unique(cells_of, return_counts=True)
            feature = pa.array([name]).take(pa.array(np.zeros(len(values), np.int32)))
            yield pa.record_batch([feature, pa.array(values), pa.array(counts)], ["feature", "value", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= COUNTED_ROWS:
                yield from counted(parts)
                parts, rows = [], 0
        if rows:
            yield from counted(parts)

    found = df.select(*[quoted(f) for f in names]).mapInArrow(run, "feature string, value long, cnt long")
    kind = "bigint" if any(not isinstance(df.schema[f].dataType, T.IntegerType) for f in names) else "int"
    # Runs are counted already, so nothing is lost by dealing them before they are added up: to as many
    # tasks as the rows have, if the session's number is smaller.
    parts = df.rdd.getNumPartitions()
    if parts > shuffle_parts(df.sparkSession):
        found = found.repartition(parts, "feature", "value")
    total = found.groupBy("feature", "value").agg(F.sum("cnt").alias("cnt"))
    return total.withColumn("value", F.col("value").cast(kind))


def cardinality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of distinct values per column."""
    return (
        distinct_values(df, features)
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("cardinality"))
    )


def _order(kind: str) -> list[Column]:
    orders = {
        "frequency": [F.col("cnt").desc(), F.col("value").cast("string").desc()],
        "sorted": [F.col("value").asc()],
        "first_seen": [F.col("first").asc()],
    }
    return orders[kind]


def _lead(counts: DataFrame, kind: str, features: Sequence[str]) -> Column | None:
    """One number to sort by first: the column's place and its first order key."""
    keys = {"frequency": -F.col("cnt"), "sorted": F.col("value"), "first_seen": F.col("first")}
    used = {"frequency": "cnt", "sorted": "value", "first_seen": "first"}
    if not isinstance(counts.schema[used[kind]].dataType, T.IntegralType):
        return None
    names = sorted(features)
    code = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("feature")) - 1
    return lead_of(code, len(names), keys[kind].cast("bigint"))


def fit_vocabulary(
    df: DataFrame,
    features: Sequence[str],
    order: str = "frequency",
    row_key: str | None = None,
    min_count: int = 0,
    first_id: int = 0,
) -> DataFrame:
    """Learn a vocabulary in one pass over ``df``.

    ``order`` numbers values by ``frequency`` (ties by descending text), by
    ``sorted`` value, or by ``first_seen`` row (which needs ``row_key``).
    Values rarer than ``min_count`` get no id; ids start at ``first_id``.
    """
    if (order == "first_seen") != (row_key is not None):
        raise ValueError("give row_key for order='first_seen', and only then")
    counted = value_counts(df, features, row_key).where(F.col("cnt") >= min_count)
    counts, rows = store_counted(counted, "value-counts")
    numbered = number_rows(
        counts,
        _order(order),
        within=["feature"],
        name="idx",
        start=first_id,
        rows=rows,
        lead=_lead(counts, order, features),
    )
    return keep_vocabulary(numbered)


def keep_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Store a vocabulary by feature, so that each column reads only its own part."""
    shape = vocabulary.select("value", "idx", "cnt", "feature")
    return store(shape, "vocabulary", partition_by="feature")


def extend_vocabulary(
    old: DataFrame, df: DataFrame, features: Sequence[str], row_key: str
) -> DataFrame:
    """Append unseen values in order of appearance; existing ids never change."""
    unseen = value_counts(df, features, row_key).join(
        old.select("feature", "value"), ["feature", "value"], "left_anti"
    )
    counts, rows = store_counted(unseen, "unseen-values")
    numbered = number_rows(
        counts,
        _order("first_seen"),
        within=["feature"],
        name="_n",
        rows=rows,
        lead=_lead(counts, "first_seen", features),
    )
    # One row per column.
    last = F.broadcast(old.groupBy("feature").agg(F.max("idx").alias("_last")))
    added = numbered.join(last, "feature", "left").select(
        "value",
        (F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("_n")).alias("idx"),
        "cnt",
        "feature",
    )
    return keep_vocabulary(old.select("value", "idx", "cnt", "feature").unionByName(added))


def identity_vocabulary(spark: SparkSession, features: Sequence[str], m: int) -> DataFrame:
    """Every value in [0, m) is its own id, for each column."""
    names = F.explode(F.array(*[F.lit(f) for f in features]))
    return spark.range(m).select(
        F.col("id").alias("value"),
        F.col("id").alias("idx"),
        F.lit(0).cast("bigint").alias("cnt"),
        names.alias("feature"),
    )


def apply_identity(c: Column, m: int) -> Column:
    """Applying ``identity_vocabulary`` is a range test; no table is built."""
    return F.when((c >= 0) & (c < m), c)


def _settle(idx: Column, unseen: str, oov_id: int) -> Column:
    if unseen == "null":
        return idx
    if unseen == "oov":
        return F.coalesce(idx, F.lit(oov_id).cast("bigint"))
    if unseen == "error":
        failure = F.raise_error(F.lit("value is not in the vocabulary"))
        return F.coalesce(idx, failure.cast("bigint"))
    raise ValueError(f"unseen must be null, oov or error, not {unseen!r}")


def apply_vocabulary(
    df: DataFrame,
    features: Sequence[str],
    vocabulary: DataFrame,
    unseen: str = "null",
    oov_id: int = -1,
    row_key: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace values by ids in every feature column.

    Vocabularies are broadcast, smallest first, while their measured rows stay
    within ``broadcast_rows`` in total: those of integers as one sorted array
    for all columns, those of text as one joined table per column. The other
    columns share one shuffled lookup of their cells, for which ``df`` is kept
    once. Cells find their row again by ``row_key``, or without one by a number
    that the kept rows get.
    """
    wanted = vocabulary.where(F.col("feature").isin(list(features)))
    weight = F.count(F.lit(1)).cast("double")
    if isinstance(vocabulary.schema["value"].dataType, T.StringType):
        weight = weight + F.sum(F.octet_length("value")) / TEXT_BYTES_PER_ROW
    measured = wanted.groupBy("feature").agg(weight.alias("rows"))
    sizes = {r["feature"]: r["rows"] for r in measured.collect()}  # one row per column
    small, used = [], 0
    for f in sorted(features, key=lambda f: sizes.get(f, 0)):
        used += sizes.get(f, 0)
        if used > broadcast_rows:
            break
        small.append(f)
    large = [f for f in features if f not in small]
    out = df
    if large:
        numbered = df if row_key else df.withColumn("_row", F.monotonically_increasing_id())
        kept, heavy = store_with_heavy(numbered, large, "rows")
        out = _apply_shuffled(kept, large, wanted, row_key or "_row", heavy)
    if small and _packable(df, small, vocabulary):
        looked_up = _apply_packed(out, small, wanted, unseen, oov_id)
        return looked_up.select(
            *[
                _settle(quoted(f"_i_{c}"), unseen, oov_id).alias(c) if c in large else quoted(c)
                for c in df.columns
            ]
        )
    for f in small:
        part = wanted.where(F.col("feature") == f).select(
            F.col("value").alias(f"_v_{f}"), F.col("idx").alias(f"_i_{f}")
        )
        out = out.join(F.broadcast(part), quoted(f) == quoted(f"_v_{f}"), "left")
    return out.select(
        *[
            _settle(quoted(f"_i_{c}"), unseen, oov_id).alias(c) if c in features else quoted(c)
            for c in df.columns
        ]
    )


def _packable(df: DataFrame, features: Sequence[str], vocabulary: DataFrame) -> bool:
    """Whether values are integers and rows can go through Arrow."""
    kinds = [vocabulary.schema["value"].dataType, *[df.schema[f].dataType for f in features]]
    try:
        to_arrow_schema(df.schema)
    except PySparkException:
        return False
    return all(isinstance(k, T.IntegralType) for k in kinds)


class Packed:
    """The vocabularies of all columns: one array of values sorted by column, and their ids."""

    def __init__(self, features: Sequence[str], entries: pa.Table):
        codes = pc.index_in(entries["feature"], pa.array(list(features))).to_numpy()
        values, ids = entries["value"].to_numpy(), entries["idx"].to_numpy()
        order = np.lexsort((values, codes))
        self.values, self.ids = values[order].astype(np.int64), ids[order].astype(np.int64)
        starts = np.searchsorted(codes[order], np.arange(len(features) + 1))
        self.part = {f: (starts[i], starts[i + 1]) for i, f in enumerate(features)}

    def lookup(self, feature: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of values, and which of them are known."""
        start, stop = self.part[feature]
        values, ids = self.values[start:stop], self.ids[start:stop]
        if start == stop:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if values[0] == 0 and values[-1] == len(values) - 1:  # every value up to the last
            at = np.clip(wanted, 0, len(values) - 1)
        else:
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return ids[at], values[at] == wanted


def _apply_packed(
    df: DataFrame, features: Sequence[str], vocabulary: DataFrame, unseen: str, oov_id: int
) -> DataFrame:
    """Look the columns up in one broadcast dictionary, all in one pass over Arrow batches.

    The caller has measured that the vocabularies are small enough.
    """
    _settle(F.lit(None), unseen, oov_id)  # a wrong name fails before any task runs
    entries = vocabulary.where(F.col("feature").isin(list(features))).select("feature", "value", "idx")
    packed = df.sparkSession.sparkContext.broadcast(Packed(features, entries.toArrow()))
    wanted = set(features)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name, column in zip(names, batch.columns):
                if name in wanted:
                    given = column.is_valid().to_numpy(zero_copy_only=False)
                    cells_of = column.fill_null(0).cast(pa.int64()).to_numpy()
                    ids, known = packed.value.lookup(name, cells_of)
                    known &= given
                    if unseen == "error" and not known.all():
                        raise ValueError("value is not in the vocabulary")
                    if unseen == "oov":
                        column = pa.array(np.where(known, ids, oov_id))
                    else:
                        column = pa.array(ids, mask=~known)
                columns.append(column)
            yield pa.record_batch(columns, names)

    schema = T.StructType(
        [T.StructField(f.name, T.LongType()) if f.name in wanted else f for f in df.schema.fields]
    )
    return df.mapInArrow(run, schema)


def _heavy_cells(long: DataFrame, heavy: list[tuple]) -> DataFrame:
    """Frequent values, at most ``HOT_KEYS``, as cells of the same types."""
    shape = long.select("feature", "value").schema
    found = long.sparkSession.createDataFrame([(c, v) for c, v, _ in heavy], shape)
    return store(found.coalesce(1), "heavy-keys")


def _apply_shuffled(
    df: DataFrame, features: Sequence[str], vocabulary: DataFrame, row_key: str, heavy: list[tuple]
) -> DataFrame:
    """Look the cells of ``features`` up together and put the ids beside their rows.

    Frequent values, at most ``HOT_KEYS``, are answered where their rows are. Only cells of other
    values are shuffled, and of these only the known ones come back to their rows.
    """
    long = cells(df, features, [row_key])
    asked = _heavy_cells(long, heavy)
    entries = vocabulary.select("feature", "value", "idx")
    answered = store(entries.join(F.broadcast(asked), ["feature", "value"]).coalesce(1), "heavy-rows")
    rare = long.join(F.broadcast(asked), ["feature", "value"], "left_anti")
    names = F.array(*[F.lit(f) for f in features])
    coded = [F.array_position(names, F.col("feature")).cast("int").alias("_code"), "value"]
    found = rare.select(row_key, *coded).join(entries.select(*coded, "idx"), ["_code", "value"])
    # Dealt by row before they are gathered: as narrow rows, not with a column for each feature.
    ids = found.select(row_key, "_code", "idx").repartition(row_key).groupBy(row_key).agg(
        *[F.max(F.when(F.col("_code") == i, F.col("idx"))).alias(f"_i_{f}") for i, f in enumerate(features, start=1)]
    )
    out = df.join(ids, row_key, "left")
    for f in sorted({c for c, _, _ in heavy}):
        part = answered.where(F.col("feature") == f).select(F.col("value").alias("_v"), F.col("idx").alias("_hot"))
        out = out.join(F.broadcast(part), quoted(f) == F.col("_v"), "left")
        out = out.withColumn(f"_i_{f}", F.coalesce("_hot", quoted(f"_i_{f}"))).drop("_v", "_hot")
    return out


def apply_to_files(
    df: DataFrame,
    features: Sequence[str],
    vocabulary: DataFrame,
    path: str,
    keys: Sequence[str],
    oov_id: int = -1,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Apply a vocabulary and write each feature of each input file apart.

    ``df`` is a plain file scan. Output folders are ``feature=F/source=FILE``;
    ``keys`` are written along. Cells are looked up as they are written, so a
    vocabulary of any size needs no row key. For one too large to broadcast, the
    columns used are kept first, with a sketch of their frequent values: the
    files are read once.
    """
    source = F.col("_metadata.file_name").alias("source")
    named = df.select(*[quoted(c) for c in df.columns], source)
    wanted = vocabulary.where(F.col("feature").isin(list(features))).select("feature", "value", "idx")
    long = cells(named, features, ["source", *keys])
    if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = long.join(F.broadcast(wanted), ["feature", "value"], "left")
    else:
        used = named.select("source", *[quoted(c) for c in dict.fromkeys([*keys, *features])])
        kept, heavy = store_with_heavy(used, features, "cells")
        long = cells(kept, features, ["source", *keys])
        found = skewed_lookup(long, wanted, ["feature", "value"], heavy=_heavy_cells(long, heavy))
    found = found.withColumn("idx", _settle(F.col("idx"), "oov", oov_id))
    out = found.select("source", *[quoted(k) for k in keys], "feature", "idx")
    out.write.partitionBy("feature", "source").parquet(path)


class Categorify(Estimator):
    """Learns one vocabulary per column; usable in a ``pyspark.ml.Pipeline``."""

    def __init__(
        self,
        features: Sequence[str],
        order: str = "frequency",
        row_key: str | None = None,
        min_count: int = 0,
        first_id: int = 0,
        unseen: str = "oov",
        oov_id: int = -1,
        broadcast_rows: int = BROADCAST_ROWS,
    ):
        super().__init__()
        self.broadcast_rows = broadcast_rows
        self.features = list(features)
        self.order = order
        self.row_key = row_key
        self.min_count = min_count
        self.first_id = first_id
        self.unseen = unseen
        self.oov_id = oov_id

    def _fit(self, dataset: DataFrame) -> CategorifyModel:
        vocabulary = fit_vocabulary(
            dataset,
            self.features,
            self.order,
            self.row_key if self.order == "first_seen" else None,
            self.min_count,
            self.first_id,
        )
        return CategorifyModel(
            vocabulary, self.features, self.unseen, self.oov_id, self.row_key, self.broadcast_rows
        )


class CategorifyModel(Model):
    """Applies a learned or loaded vocabulary."""

    def __init__(
        self,
        vocabulary: DataFrame,
        features: Sequence[str],
        unseen: str = "oov",
        oov_id: int = -1,
        row_key: str | None = None,
        broadcast_rows: int = BROADCAST_ROWS,
    ):
        super().__init__()
        self.broadcast_rows = broadcast_rows
        self.vocabulary = vocabulary
        self.features = list(features)
        self.unseen = unseen
        self.oov_id = oov_id
        self.row_key = row_key

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_vocabulary(
            dataset,
            self.features,
            self.vocabulary,
            self.unseen,
            self.oov_id,
            self.row_key,
            self.broadcast_rows,
        )
