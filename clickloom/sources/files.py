"""Files for the Python data sources: listing, byte ranges, output parts.

This module runs inside tasks, so it holds small helpers only.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

MARKER = "_committed-"
_PART = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain absolute path is a local one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def list_files(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """``(path, bytes)`` of the data files under a path, in name order.

    Hidden files and folders are skipped, and so are parts of a job of this
    library that no marker of a finished job names.
    """
    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    files = [
        f
        for f in fs.get_file_info(pafs.FileSelector(path, recursive=True))
        if f.type == pafs.FileType.File
    ]
    finished = set()
    for f in files:
        if f.base_name.startswith(MARKER):
            with fs.open_input_stream(f.path) as source:
                names = source.read().decode().split()
            finished.update(posixpath.join(posixpath.dirname(f.path), n) for n in names)
    root = len(path.rstrip("/")) + 1
    found = [
        f
        for f in files
        if not any(p.startswith(("_", ".")) for p in f.path[root:].split("/"))
        and (f.path in finished or not _PART.match(f.base_name))
        and fnmatch.fnmatch(f.base_name, pattern)
    ]
    if not found:
        raise FileNotFoundError(f"no file matches {uri}/{pattern}")
    return sorted((f.path, f.size) for f in found)


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class FileRanges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[FileRange]


# Bytes of ranges that go to one task, if ranges are smaller.
TASK_BYTES = 32 * 1024 * 1024


def dealt(ranges: list[FileRange], task_bytes: int = TASK_BYTES) -> list[FileRanges]:
    """Neighbouring ranges together, up to ``task_bytes`` each: a task costs more than a small range."""
    tasks: list[FileRanges] = []
    held = task_bytes
    for r in ranges:
        size = r.stop - r.start
        if held + size > task_bytes:
            tasks.append(FileRanges([]))
            held = 0
        tasks[-1].ranges.append(r)
        held += size
    return tasks


@dataclass
class PartWritten(WriterCommitMessage):
    name: str


class JobParts:
    """Part files of one write job, beside those of earlier jobs.

    Every task attempt writes a file of its own name, so retried and speculative
    attempts never meet. The job ends with one marker that names the attempts
    that count; nothing is moved, and other files are not data to ``list_files``.
    """

    def __init__(self, uri: str, suffix: str):
        self.uri = uri
        self.suffix = suffix
        self.job = uuid.uuid4().hex

    def write(self, chunks: Iterator[bytes]) -> PartWritten:
        fs, path = open_fs(self.uri)
        fs.create_dir(path, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}{self.suffix}"
        with fs.open_output_stream(posixpath.join(path, name)) as out:
            for chunk in chunks:
                out.write(chunk)
        return PartWritten(name)

    def commit(self, messages) -> None:
        fs, path = open_fs(self.uri)
        fs.create_dir(path, recursive=True)
        names = "\n".join(m.name for m in messages if m is not None)
        with fs.open_output_stream(posixpath.join(path, f"{MARKER}{self.job}")) as out:
            out.write(names.encode())

    def abort(self) -> None:
        fs, path = open_fs(self.uri)
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return
        for f in fs.get_file_info(pafs.FileSelector(path)):
            if f.base_name.startswith(f"part-{self.job}-"):
                fs.delete_file(f.path)
