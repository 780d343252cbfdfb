"""End-to-end jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import arrays as A
from clickloom.functions import dense as D
from clickloom.functions import sparse as S
from clickloom.functions.rows import apply_by_role, fill_missing_rows, map_as_arrays, quoted
from clickloom.operators import embeddings, splits
from clickloom.operators.filters import subsample_negatives
from clickloom.operators.numbering import number_wide_rows
from clickloom.operators.vocabulary import (
    BROADCAST_ROWS,
    Categorify,
    apply_identity,
    apply_vocabulary,
    fit_vocabulary,
)
from clickloom.session import new_path, store, tune
from clickloom.sinks import files as sinks
from clickloom.sinks import stages
from clickloom.sources.clicklog import read_tsv
from clickloom.sources.vector_store import write_vector_store
from clickloom.spec import FeatureSpec

# Columns beyond which Spark compiles no stage, see ``map_as_arrays``.
WIDE_COLUMNS = 100


def preprocess(
    df: DataFrame, spec: FeatureSpec, modulus: int, keep: Sequence[str] = (), places: int | None = None
) -> DataFrame:
    """Fill, clip and log dense columns, reduce sparse ones: one projection.

    Sparse text is hexadecimal; integer sparse columns are only reduced. Dense values are rounded to
    ``places`` if given.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def sparse(name: str):
        kind = kinds[name]
        text = kind.typeName() in ("string", "char", "varchar")
        filled = D.fill_missing(quoted(name)) if text else F.coalesce(quoted(name), F.lit(0))
        return S.hex_mod(filled, modulus, kind)

    def dense(name: str):
        text = kinds[name].typeName() in ("string", "char", "varchar")
        filled = D.fill_missing(quoted(name)) if text else F.coalesce(quoted(name), F.lit(0))
        value = D.log1p(D.neg_to_zero(D.dense_double(filled)))
        return value if places is None else F.round(value, places)

    tune(df.sparkSession)
    wide = len(spec.columns) > WIDE_COLUMNS
    if wide and all(kinds[c].typeName() == "string" for c in (*spec.dense, *spec.sparse)):
        if kinds[spec.label] != T.IntegerType():
            df = df.withColumn(spec.label, D.label_int(quoted(spec.label)))
        clip_log = [A.fill_missing, A.dense_double, A.neg_to_zero, A.log1p]
        clip_log += [] if places is None else [partial(A.round_half_up, places=places)]
        reduced = [A.fill_missing, partial(A.hex_mod, m=modulus)]
        roles = [(spec.dense, clip_log, T.DoubleType()), (spec.sparse, reduced, T.LongType())]
        return map_as_arrays(df, roles, [*keep, spec.label])
    return df.select(
        *[quoted(c) for c in keep],
        D.label_int(quoted(spec.label)).alias(spec.label),
        *[dense(c).alias(c) for c in spec.dense],
        *[sparse(c).alias(c) for c in spec.sparse],
    )


def preprocess_with_vocabulary(
    df: DataFrame,
    spec: FeatureSpec,
    modulus: int,
    keep: Sequence[str] = (),
    order: str = "frequency",
    row_key: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``preprocess``, then learn and apply a vocabulary for each sparse column.

    Prepared rows are kept once: learning reads the sparse columns of them, applying reads all.
    """
    prepared = store(preprocess(df, spec, modulus, keep), "prepared")
    encoder = Categorify(
        spec.sparse, order=order, row_key=row_key, broadcast_rows=broadcast_rows
    )
    return encoder.fit(prepared).transform(prepared)


def preprocess_with_identity(
    df: DataFrame, spec: FeatureSpec, modulus: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``preprocess``, then the vocabulary of all values below ``modulus``."""
    prepared = preprocess(df, spec, modulus, keep)
    return apply_by_role(
        prepared, spec, sparse=lambda c: apply_identity(c, modulus), keep=keep
    )


def _raw(spark: SparkSession, source: str | DataFrame, spec: FeatureSpec, extra: str) -> DataFrame:
    return read_tsv(spark, source, spec, extra) if isinstance(source, str) else source


def two_pass_vocabulary(
    spark: SparkSession,
    source: str | DataFrame,
    vocabulary_path: str,
    spec: FeatureSpec,
    modulus: int,
    extra: str = "",
) -> None:
    """Pass 1: learn the vocabularies of a click log and keep them.

    ``source`` is a text click log's path, or raw rows from anywhere else.
    """
    prepared = preprocess(_raw(spark, source, spec, extra), spec, modulus)
    sinks.write_vocabulary(fit_vocabulary(prepared, spec.sparse), vocabulary_path)


def two_pass_apply(
    spark: SparkSession,
    source: str | DataFrame,
    vocabulary_path: str,
    target: str,
    spec: FeatureSpec,
    modulus: int,
    extra: str = "",
    keep: Sequence[str] = (),
    kind: str = "tsv",
    row_key: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Pass 2: apply the kept vocabularies and write rows, ``kind`` ``tsv`` or ``parquet``."""
    if kind not in ("tsv", "parquet"):
        raise ValueError(f"kind must be tsv or parquet, not {kind!r}")
    prepared = preprocess(_raw(spark, source, spec, extra), spec, modulus, keep)
    vocabulary = sinks.read_vocabulary(spark, vocabulary_path)
    encoded = apply_vocabulary(
        prepared, spec.sparse, vocabulary, "oov", row_key=row_key, broadcast_rows=broadcast_rows
    )
    write = sinks.write_tsv if kind == "tsv" else sinks.write_snappy
    write(encoded, target)


def prepare_days(
    df: DataFrame,
    spec: FeatureSpec,
    row_key: str,
    days: int,
    modulus: int,
    negatives_rate: float = 0.0,
    randomize: str = "none",
    holdout: bool = True,
    seed: int = 0,
    split: str | None = None,
    folder: str | None = None,
    source: str | None = None,
    recreate: bool = False,
) -> DataFrame:
    """Raw rows to training rows by day.

    Cuts the rows into ``days`` blocks, or takes the day from column ``split``
    (0 to ``days - 1``, as ``with_split_from_file`` gives it). Drops negatives,
    prepares and encodes the columns in order of first appearance, and orders
    each day's rows: ``randomize`` is ``none``, ``day`` (inside each day) or
    ``total`` (across days). With ``holdout`` the last day keeps its rows in
    their first order.

    Prepared rows are kept once. Blocks of each day are cut and counted by keys
    alone, and wide rows move once, to the task that sorts their block. With ``folder`` every stage is kept there,
    the result by day. A later call builds anew the stages that its arguments or
    its input change, and reuses the others; ``recreate`` builds all. An input
    that is not plain files is read once to know its rows; ``source``, any text
    that stands for its content, saves that.
    """
    if randomize not in ("none", "day", "total"):
        raise ValueError(f"randomize must be none, day or total, not {randomize!r}")
    spark = df.sparkSession
    kept_in = folder or new_path(spark, "days")
    if folder is None:
        origin = ""  # a fresh folder has nothing to compare
    else:
        origin = stages.source_fingerprint(df) if source is None else f"source {source}"
    drawn = {"rate": negatives_rate, "seed": seed if negatives_rate else None}
    columns = {"label": spec.label, "dense": spec.dense, "sparse": spec.sparse, "row_key": row_key}
    encoded_by = {"modulus": modulus, **drawn, **columns}
    cut_by = {"days": days} if split is None else {"split": split}

    def prepared() -> DataFrame:
        if split is None:
            blocks = splits.split_contiguous(df, row_key, days)
        else:
            blocks = df.withColumn("split", F.col(split).cast("int"))
        labelled = blocks.withColumn(spec.label, D.label_int(quoted(spec.label)))
        kept = subsample_negatives(labelled, spec.label, negatives_rate, row_key, seed)
        return preprocess(kept, spec, modulus, [row_key, "split"])

    rows = stages.write_if_changed(
        spark, f"{kept_in}/prepared", prepared, {**encoded_by, **cut_by}, [origin], recreate=recreate
    )

    def vocabulary() -> DataFrame:
        return fit_vocabulary(rows, spec.sparse, "first_seen", row_key)

    # The days of the rows do not matter to their values.
    known = stages.write_if_changed(
        spark, f"{kept_in}/vocabulary", vocabulary, encoded_by, [origin], recreate=recreate
    )
    last = days - 1 if holdout else None

    def ordered() -> DataFrame:
        narrow = rows.select(row_key, "split")
        encoded = apply_vocabulary(rows, spec.sparse, known, "oov", row_key=row_key)
        # Keys that are not integers cannot be cut into blocks: their places are joined to the rows.
        whole = isinstance(rows.schema[row_key].dataType, T.IntegralType)
        moved, keys = (encoded, narrow) if whole else (narrow, None)
        if randomize == "total":
            dealt = splits.shuffle_into_splits(moved, "split", row_key, last, seed, keys)
            placed = dealt.drop("split").withColumnRenamed("bucket", "split")
        elif randomize == "day":
            placed = splits.shuffle_within_split(moved, "split", row_key, seed, last, narrow=keys)
        elif whole:
            placed = number_wide_rows(encoded, [F.col(row_key)], "split", F.col(row_key), narrow, "slot")
        else:
            placed = splits.number_rows(narrow, [F.col(row_key)], within=["split"], name="slot")
        if not whole:
            placed = encoded.drop("split").join(placed, row_key)
        columns = [quoted(c) for c in encoded.columns if c not in (row_key, "split")]
        return placed.select(row_key, "split", *columns, "slot")

    if folder is None:
        return ordered()
    order = {"randomize": randomize}
    if randomize != "none":
        order |= {"last": last, "seed": seed}
    return stages.write_if_changed(
        spark, f"{folder}/days", ordered, {**encoded_by, **cut_by, "order": order}, [origin], ["split"], recreate
    )


def text_to_vectors(
    docs: DataFrame, words: DataFrame, dim: int, seed: int = 0, doc: str = "doc_id"
) -> DataFrame:
    """Documents to one vector per letter-only token, in order."""
    found = embeddings.lookup_words(docs, words, doc)
    return embeddings.fill_unknown(found, dim, seed, doc)


def text_to_vector_batches(
    docs: DataFrame, words: DataFrame, dim: int, seed: int = 0, doc: str = "doc_id",
    size: int = embeddings.BATCH,
) -> DataFrame:
    """Documents to arrays of at most ``size`` vectors, one per letter-only token, in order.

    The word table becomes a store of mapped files, and documents are not shuffled. Only a table whose
    vectors do not all have ``dim`` components is joined to single tokens.
    """
    if embeddings.table_shape(words)[1] == dim:
        return embeddings.vector_sequences(docs, write_vector_store(words, dim), seed, size, doc)
    return embeddings.vector_batches(text_to_vectors(docs, words, dim, seed, doc), size, doc)


def typed_parquet(
    spark: SparkSession, source: str, target: str, spec: FeatureSpec, extra: str = "",
    keep: Sequence[str] = (),
) -> None:
    """Text click log to Parquet: INT label and dense, 8-character hexadecimal."""
    raw = fill_missing_rows(read_tsv(spark, source, spec, extra), spec, keep)
    typed = apply_by_role(
        raw,
        spec,
        dense=lambda c: c.cast("int"),
        sparse=S.hex_zero_pad,
        label=D.label_int,
        keep=keep,
    )
    sinks.write_snappy(typed, target)
