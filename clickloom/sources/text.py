"""Documents and word-vector tables."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from clickloom.session import store
from clickloom.sources.files import open_fs


class DocumentFiles(DataSource):
    """Options: ``path``, ``key``. Writes ``folder`` and ``text`` as one file a row."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "folder STRING, text STRING"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["key"])


class DocumentWriter(DataSourceArrowWriter):
    """A file's name follows from its text, so a retried task writes the same files again.

    A file takes its name when it is whole; until then it is hidden.
    """

    def __init__(self, path: str, key: str):
        self.path = path
        self.key = key

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        copies: Counter[tuple[str, str]] = Counter()
        for batch in iterator:
            texts = batch.column(1).cast(pa.binary())
            for value, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                text = text or b""
                named = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe=" ")
                folder, name = f"{root}/{self.key}={named}", hashlib.md5(text, usedforsecurity=False).hexdigest()
                copies[named, name] += 1
                name = f"{name}-{copies[named, name]}.txt"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/.{name}") as out:
                    out.write(text + b"\n")
                fs.move(f"{folder}/.{name}", f"{folder}/{name}")
        return WriterCommitMessage()


def write_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One UTF-8 file with a line break behind it for each row, in a folder ``key=VALUE``.

    Spark's text writer makes and commits a file in about 14 ms of a core, this in a fraction of that.
    All rows of a key are written by one task.
    """
    spark = df.sparkSession
    spark.dataSource.register(DocumentFiles)
    tasks = max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    rows = df.select(F.col(key).cast("string").alias("folder"), F.col(text).alias("text"))
    writer = rows.repartition(tasks, "folder").write.format("document_files").option("key", key)
    writer.mode("append").save(path)


def _glob(pattern: str) -> str:
    """A regular expression for names that a pattern of Hadoop's matches: ``* ? [a-z] [^a] {a,b}``, and escapes."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "^!" else inside).replace("[", r"\[") + "]"
            i = end
        elif c == "{" or (depth and c in ",}"):
            out += {"{": "(?:", ",": "|", "}": ")"}[c]
            depth += {"{": 1, ",": 0, "}": -1}[c]
        else:
            out += re.escape(c)
        i += 1
    return out


def _shown(name: str, folder: bool) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _entries(uri: str, path: str) -> Iterator[tuple[str, int, bool]]:
    """Path, bytes and whether it is a folder, of what lies in a folder."""
    fs, _ = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        # One by one: a folder may hold millions.
        with os.scandir(path) as found:
            for f in found:
                folder = f.is_dir()
                if _shown(f.name, folder):
                    yield f.path, 0 if folder else f.stat().st_size, folder
        return
    for f in fs.get_file_info(pafs.FileSelector(path)):
        folder = f.type == pafs.FileType.Directory
        if _shown(f.base_name, folder):
            yield f.path, f.size or 0, folder


# Rows and bytes of a batch, folders that one task lists, files and bytes that one task reads.
_ROWS, _BYTES = 2_000, 16 * 1024 * 1024
_TASK_FOLDERS, _TASK_FILES, _TASK_BYTES = 20_000, 20_000, 128 * 1024 * 1024


def _in_tasks(df: DataFrame, tasks: int) -> DataFrame:
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def list_documents(spark: SparkSession, uri: str, pattern: str = "*") -> tuple[DataFrame, int, int]:
    """Non-empty files below a folder (``path``, ``size``) whose names match, how many they are, and their bytes.

    Tasks list the folders of one depth after another, so that the driver never holds their names.
    """
    name = re.compile(_glob(pattern), re.DOTALL)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[tuple[str, int, bool]]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for entry in _entries(uri, path):
                        if entry[2] or (entry[1] and name.fullmatch(posixpath.basename(entry[0]))):
                            yield entry

        found = wanted()
        while rows := list(islice(found, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "size", "folder"])

    level = spark.createDataFrame([(open_fs(uri)[1],)], "path string").coalesce(1)
    files, many, size = [], 0, 0
    while True:
        at = Observation()
        folder = F.col("folder")
        entries = level.mapInArrow(listed, "path string, size long, folder boolean").observe(
            at, F.count_if(folder).alias("folders"), F.count_if(~folder).alias("files"), F.sum("size").alias("size")
        )
        entries = store(entries, "documents-found")
        counts = at.get
        files.append(entries.where(~folder).select("path", "size"))
        many, size = many + counts["files"], size + (counts["size"] or 0)
        if not counts["folders"]:
            return reduce(DataFrame.unionByName, files), many, size
        level = _in_tasks(entries.where(folder).select("path"), -(-counts["folders"] // _TASK_FOLDERS))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Each matching file as one UTF-8 document, keyed by its path below ``folder``.

    Folders below are read as well, also those named like partitions. Tasks list the files and read them:
    Spark's own reader, which holds every file's name in the driver, reads only stores that workers cannot open.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    qualified = fs.makeQualified(root).toUri()
    base = qualified.getPath().rstrip("/")
    uri = base if qualified.getScheme() == "file" else qualified.toString()
    try:
        open_fs(uri)
        many_files = fs.exists(root) and fs.getFileStatus(root).isDirectory()
    except (pa.ArrowException, OSError):
        many_files = False
    if not many_files:
        path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        found = reader.text(folder, wholetext=True)
        return found.select(F.substring_index(path, f"{base}/", -1).alias("doc_id"), F.col("value").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_fs(uri)
        paths, texts, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                # Compressed files by their ending, as Spark reads them.
                with files.open_input_stream(path) as source:
                    texts.append(source.read())
                paths.append(path)
                held += len(texts[-1])
                if len(paths) >= _ROWS or held >= _BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "text"])
                    paths, texts, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "text"])

    files, many, size = list_documents(spark, uri, pattern)
    tasks = max(-(-many // _TASK_FILES), -(-size // _TASK_BYTES))
    rows = _in_tasks(files, tasks).mapInArrow(read, "path string, text binary")
    top = open_fs(uri)[1].rstrip("/") + "/"
    below = F.expr("substring(path, {})".format(len(top) + 1))
    return rows.select(below.alias("doc_id"), F.col("text").cast("string").alias("text"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word table ``(word, idx, vec)`` in Parquet; ``idx`` is the word's position."""
    return spark.read.parquet(path).select(
        "word", F.col("idx").cast("bigint"), F.col("vec").cast("array<float>")
    )
