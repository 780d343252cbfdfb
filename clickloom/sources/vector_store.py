"""Word vectors in Arrow files that tasks map into memory.

A store is a folder of Arrow files, written once, in order of a 64-bit hash of the word. A task maps
the files instead of reading them: only the pages of the words it meets are loaded, and the workers
of a machine share them. So a word table of any size serves every task without a shuffle or a
broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from clickloom.session import new_path, store
from clickloom.sources.files import JobParts, list_files, open_fs

BATCH_ROWS = 1 << 16
_SEEDS = 8


@dataclass(frozen=True)
class VectorStore:
    """Where a store lies, the seed of its hash, and the length of its vectors."""

    path: str
    seed: int
    dim: int

    def keys(self, tokens: Column) -> Column:
        """Hashes of an array of words."""
        return F.transform(tokens, lambda t: F.xxhash64(F.lit(self.seed), t))


class VectorFiles(DataSource):
    """Options: ``path``, ``dim``. Writes ``key``, ``word``, ``idx``, ``vec`` as Arrow files."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> str:
        return "key BIGINT, word STRING, idx BIGINT, vec ARRAY<FLOAT>"

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], int(self.options["dim"]))


class _Sink:
    """What an Arrow writer has written since it was last asked."""

    closed = False

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0

    def write(self, data) -> int:
        self.parts.append(bytes(data))
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def taken(self) -> bytes:
        parts, self.parts = self.parts, []
        return b"".join(parts)


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dim: int):
        self.parts = JobParts(path, ".arrow")
        self.dim = dim

    def write(self, iterator: Iterator[pa.RecordBatch]):
        fields = [("key", pa.int64()), ("word", pa.string()), ("idx", pa.int64())]
        schema = pa.schema([*fields, ("vec", pa.list_(pa.float32(), self.dim))])

        def chunks() -> Iterator[bytes]:
            sink = _Sink()
            with pa.ipc.new_file(pa.PythonFile(sink, mode="w"), schema) as out:
                for batch in iterator:
                    vec = batch.column("vec").flatten().cast(pa.float32())
                    columns = [batch.column(n).cast(t) for n, t in fields]
                    columns.append(pa.FixedSizeListArray.from_arrays(vec, self.dim))
                    out.write_batch(pa.record_batch(columns, schema=schema))
                    yield sink.taken()
            yield sink.taken()

        return self.parts.write(chunks())

    def commit(self, messages) -> None:
        self.parts.commit(messages)

    def abort(self, messages) -> None:
        self.parts.abort()


def write_vector_store(words: DataFrame, dim: int) -> VectorStore:
    """Keep ``(word, idx, vec)``, with unique words and ``dim`` components each, in the shared folder.

    A seed is chosen under which no two words have the same hash. A null word is left out: no token
    is null.
    """
    spark = words.sparkSession
    known = store(words.where(F.col("word").isNotNull()).select("word", "idx", "vec"), "word-table")
    for seed in range(_SEEDS):
        keyed = known.withColumn("key", F.xxhash64(F.lit(seed), F.col("word")))
        if not keyed.groupBy("key").count().where("count > 1").limit(1).count():
            break
    else:
        raise ValueError("the word table has a word twice")
    path = new_path(spark, "vectors")
    spark.dataSource.register(VectorFiles)
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key")
    writer = ordered.select("key", "word", "idx", "vec").write.format("vector_files")
    writer.option("dim", str(dim)).mode("append").save(path)
    return VectorStore(path, seed, dim)


class Opened:
    """A store as a task sees it."""

    def __init__(self, path: str, dim: int):
        self.dim = dim
        self.batches: list[tuple[pa.ipc.RecordBatchFileReader, int]] = []
        keys = []
        fs, _ = open_fs(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        for name, _ in list_files(path):
            source = pa.memory_map(name) if local else fs.open_input_file(name)
            reader = pa.ipc.open_file(source)
            # Of files that cannot be mapped, the hashes are held and the rest is read when asked for.
            only = reader if local else pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[0]))
            for i in range(reader.num_record_batches):
                found = only.get_batch(i).column(0).to_numpy()
                if len(found):
                    keys.append(found)
                    self.batches.append((reader, i))
        order = sorted(range(len(keys)), key=lambda i: keys[i][0])
        self.keys = [keys[i] for i in order]
        self.batches = [self.batches[i] for i in order]
        self.first = np.array([k[0] for k in self.keys], np.int64)

    def lookup(self, keys: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, its ``idx``, and its vector; unknown ones have zeros."""
        known = np.zeros(len(keys), bool)
        idx = np.zeros(len(keys), np.int64)
        vectors = np.zeros((len(keys), self.dim), np.float32)
        part = np.searchsorted(self.first, keys, side="right") - 1
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-2))
        for begin, end in zip(cuts, [*cuts[1:], len(order)]):
            own = order[begin:end]
            if part[own[0]] < 0:
                continue
            held = self.keys[part[own[0]]]
            at = np.minimum(np.searchsorted(held, keys[own]), len(held) - 1)
            hit = held[at] == keys[own]
            own, at = own[hit], at[hit]
            if not len(own):
                continue
            reader, i = self.batches[part[own[0]]]
            batch = reader.get_batch(i)
            same = pc.equal(batch.column(1).take(pa.array(at)), words.take(pa.array(own)))
            same = same.to_numpy(zero_copy_only=False).astype(bool)
            own, at = own[same], at[same]
            known[own] = True
            idx[own] = batch.column(2).to_numpy()[at]
            vectors[own] = batch.column(3).flatten().to_numpy().reshape(-1, self.dim)[at]
        return known, idx, vectors


@functools.lru_cache(maxsize=4)
def opened(path: str, dim: int) -> Opened:
    """Each Python worker opens a store once."""
    return Opened(path, dim)
