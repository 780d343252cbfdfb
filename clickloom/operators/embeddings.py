"""Token sequences and their vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.draws import digest, gaussian_rows, gaussian_vectors
from clickloom.functions.text import preprocess_text
from clickloom.operators.lookup import SAMPLE, skewed_lookup
from clickloom.session import store
from clickloom.sources.vector_store import VectorStore, opened, write_vector_store

# Bytes of a word table that may be broadcast: words, vectors and 64 bytes a row.
BROADCAST_BYTES = 48_000_000
BATCH = 512
TASK_FLOATS = 1 << 21  # components that a task makes at once


def tokenized(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their letter-only tokens for their text, kept so that tokens are made once.

    All functions here take such documents as well.
    """
    return store(docs.select(doc, preprocess_text(F.col(text)).alias(text)), "tokens")


def _tokens(docs: DataFrame, text: str) -> Column:
    made = isinstance(docs.schema[text].dataType, T.ArrayType)
    return F.col(text) if made else preprocess_text(F.col(text))


def token_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, pos, token)`` for the letter-only tokens of each document."""
    return docs.select(
        doc, F.posexplode(_tokens(docs, text)).alias("pos", "token")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def _table_bytes(words: DataFrame) -> Column:
    floats = F.greatest(F.coalesce(F.size("vec"), F.lit(0)), F.lit(0))
    row = F.lit(64) + F.coalesce(F.octet_length("word"), F.lit(0)) + 4 * floats
    return F.coalesce(F.sum(row.cast("bigint")), F.lit(0))


def table_shape(words: DataFrame) -> tuple[int, int | None]:
    """Bytes of a word table, and the length of its vectors if they all have the same."""
    length = F.coalesce(F.size("vec"), F.lit(-1))
    found = words.agg(_table_bytes(words).alias("bytes"), F.min(length).alias("low"), F.max(length).alias("high"))
    size, low, high = found.first()
    return size, low if low == high and low is not None and low > 0 else None


def lookup_words(
    docs: DataFrame, words: DataFrame, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokens with ``idx`` and ``vec`` of their word; NULL when it is unknown.

    A word table beyond ``BROADCAST_BYTES`` is kept as a store of mapped files. Only one whose
    vectors differ in length is joined by shuffle.
    """
    size, dim = table_shape(words)
    if size > BROADCAST_BYTES and dim:
        return lookup_in_store(docs, write_vector_store(words, dim), doc, text)
    if size > BROADCAST_BYTES:
        return lookup_shuffled(docs, words, doc, text)
    table = words.withColumnRenamed("word", "token")
    return token_rows(docs, doc, text).join(F.broadcast(table), "token", "left").select(
        doc, "pos", "token", "idx", "vec"
    )


def lookup_shuffled(
    docs: DataFrame, words: DataFrame, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``lookup_words`` by a join: only tokens outside the most frequent words are shuffled."""
    made = isinstance(docs.schema[text].dataType, T.ArrayType)
    kept = docs if made else tokenized(docs, doc, text)
    sampled = token_rows(kept.sample(SAMPLE, seed=7), doc, text)
    table = words.withColumnRenamed("word", "token")
    return skewed_lookup(token_rows(kept, doc, text), table, ["token"], sampled=sampled)


def _tokens_and_keys(docs: DataFrame, vectors: VectorStore, doc: str, text: str) -> DataFrame:
    """``doc``, its text form, and a struct of tokens and their hashes.

    The lambda binds the tokens, so they are made once for both; they are not named by any other
    expression, which would make them again.
    """
    both = F.transform(
        F.array(_tokens(docs, text)),
        lambda ts: F.struct(ts.alias("tokens"), vectors.keys(ts).alias("keys")),
    )
    return docs.select(doc, F.col(doc).cast("string").alias("named"), F.get(both, F.lit(0)).alias("both"))


def _pieces(batch: pa.RecordBatch, size: int, tokens_at_once: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """``(row, number, start, stop)`` of runs of ``size`` tokens of a row, so many that a task can hold.

    Starts and stops count the tokens of the whole batch.
    """
    lengths = batch.column(2).field(0).value_lengths().fill_null(0)  # a null text has no tokens
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    held, tokens, begin = [], 0, 0
    for row, end in enumerate(ends.tolist()):
        for number, start in enumerate(range(begin, end, size)):
            stop = min(start + size, end)
            held.append((row, number, start, stop))
            tokens += stop - start
            if tokens >= tokens_at_once:
                yield held
                held, tokens = [], 0
        begin = end
    if held:
        yield held


def _lists(values: pa.Array, lengths: Sequence[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def _looked_up(batch: pa.RecordBatch, vectors: VectorStore, start: int, stop: int):
    tokens = batch.column(2).field(0).flatten().slice(start, stop - start)
    keys = batch.column(2).field(1).flatten().slice(start, stop - start).to_numpy()
    return tokens, *opened(vectors.path, vectors.dim).lookup(keys, tokens)


def vector_sequences(
    docs: DataFrame, vectors: VectorStore, seed: int = 0, size: int = BATCH, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Vector sequences of documents: arrays of at most ``size`` vectors in token order.

    One pass without a shuffle: a task looks the tokens of its documents up in the store. Unknown
    tokens get the vectors of ``fill_unknown``. A task holds ``TASK_FLOATS`` components at once,
    however long a document is.
    """
    dim = vectors.dim
    tokens = _tokens_and_keys(docs, vectors, doc, text)
    at_once = max(1, TASK_FLOATS // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(1).to_pylist()
            for pieces in _pieces(batch, size, at_once):
                first, last = pieces[0][2], pieces[-1][3]
                words, known, _, found = _looked_up(batch, vectors, first, last)
                unknown = np.flatnonzero(~known)
                if len(unknown):
                    starts = np.array([p[2] - first for p in pieces])
                    own = np.searchsorted(starts, unknown, side="right") - 1
                    heads = [f"{seed}|" if named[r] is None else f"{seed}|{named[r]}|" for r, *_ in pieces]
                    at = unknown - starts[own] + np.array([p[1] for p in pieces])[own] * size
                    digests = [
                        hashlib.md5(f"{heads[o]}{p}".encode(), usedforsecurity=False).hexdigest()
                        for o, p in zip(own.tolist(), at.tolist())
                    ]
                    digits = np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 32)
                    found[unknown] = gaussian_rows(digits, dim)
                lengths = [p[3] - p[2] for p in pieces]
                inner = _lists(pa.array(found.reshape(-1)), [dim] * len(found))
                columns = [
                    batch.column(0).take(pa.array([p[0] for p in pieces])),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    _lists(words, lengths),
                    _lists(inner, lengths),
                ]
                yield pa.record_batch(columns, [doc, "batch", "tokens", "vecs"])

    rest = T.StructType.fromDDL("batch long, tokens array<string>, vecs array<array<float>>").fields
    return tokens.mapInArrow(run, T.StructType([tokens.schema[doc], *rest]))


def lookup_in_store(
    docs: DataFrame, vectors: VectorStore, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``lookup_words`` from a store: no vector goes through a shuffle."""
    dim = vectors.dim
    tokens = _tokens_and_keys(docs, vectors, doc, text)
    at_once = max(1, TASK_FLOATS // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _pieces(batch, BATCH, at_once):
                words, known, idx, found = _looked_up(batch, vectors, pieces[0][2], pieces[-1][3])
                rows = np.repeat([p[0] for p in pieces], [p[3] - p[2] for p in pieces])
                pos = np.concatenate([np.arange(p[3] - p[2]) + p[1] * BATCH for p in pieces])
                offsets = pa.array(np.concatenate([[0], np.cumsum(known)]) * dim, pa.int32(), mask=np.append(~known, False))
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(pos, pa.int64()),
                    words,
                    pa.array(idx, mask=~known),
                    pa.ListArray.from_arrays(offsets, pa.array(found[known].reshape(-1))),
                ]
                yield pa.record_batch(columns, [doc, "pos", "token", "idx", "vec"])

    rest = T.StructType.fromDDL("pos long, token string, idx long, vec array<float>").fields
    return tokens.mapInArrow(run, T.StructType([tokens.schema[doc], *rest]))


def fill_unknown(looked_up: DataFrame, dim: int, seed: int = 0, doc: str = "doc_id") -> DataFrame:
    """Unknown tokens get a Gaussian vector, fixed by seed, document and position."""
    unknown = F.when(F.col("vec").isNull(), digest(seed, F.col(doc), F.col("pos")))
    return looked_up.withColumn("vec", F.coalesce(F.col("vec"), gaussian_vectors(unknown, dim)))


def batch_order(looked_up: DataFrame, size: int = BATCH, doc: str = "doc_id") -> DataFrame:
    """Position when each batch lists its known tokens first, unknown ones last.

    A window group is one batch, so it never has more than ``size`` rows.
    """
    batch = F.floor(F.col("pos") / size).cast("bigint")
    window = Window.partitionBy(doc, "batch").orderBy("is_oov", "pos")
    return (
        looked_up.withColumn("batch", batch)
        .withColumn("is_oov", F.col("idx").isNull().cast("int"))
        .withColumn("out_pos", F.col("batch") * size + F.row_number().over(window) - 1)
    )


def vector_batches(filled: DataFrame, size: int = BATCH, doc: str = "doc_id") -> DataFrame:
    """Vector sequences: per document, arrays of at most ``size`` vectors in order."""
    numbered = filled.withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token", "vec")))
    return (
        numbered.groupBy(doc, "batch")
        .agg(ordered.alias("rows"))
        .select(
            doc, "batch", F.col("rows.token").alias("tokens"), F.col("rows.vec").alias("vecs")
        )
    )


def known_rate(looked_up: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tokens inside and outside the vocabulary, per document."""
    return looked_up.groupBy(doc).agg(
        F.count("idx").alias("in_vocab"),
        F.count_if(F.col("idx").isNull()).alias("out_vocab"),
    )


def split_known(tokens: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose token is a known word, and the others."""
    known = words.select(F.col("word").alias("token"))
    return tokens.join(known, "token", "left_semi"), tokens.join(known, "token", "left_anti")


def doc_token_stats(
    docs: DataFrame, dim: int | Column, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of each document, and the length of its vectors."""
    tokens = F.size(preprocess_text(F.col(text)))
    return docs.select(
        doc,
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        tokens.cast("bigint").alias("n_tokens"),
        (dim if isinstance(dim, Column) else F.lit(dim)).alias("dim"),
    )
