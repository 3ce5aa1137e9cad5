"""Byte ranges of files, read and written by tasks through the file system that a path names."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes of a file that are read at once while its header is parsed
HEAD = 1 << 16
#: tasks that read planned ranges, at most
MAX_TASKS = 10_000


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


class Ranges:
    """A file of which only what is asked for is read."""

    def __init__(self, file):
        self.file, self.head = file, None

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def small(self, at: int, size: int) -> bytes:
        """As read, from the first bytes of the file if they hold it."""
        if self.head is None:
            self.head = self.read(0, HEAD)
        return self.head[at : at + size] if at + size <= len(self.head) else self.read(at, size)


@contextmanager
def opened(path: str):
    system, name = place(path)
    with system.open_input_file(name) as file:
        yield Ranges(file)


@contextmanager
def created(path: str):
    """A stream whose file has its name only once all is written, so that a lost attempt leaves none."""
    system, name = place(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{last}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(hidden) as out:
        yield out
    system.move(hidden, name)


def listed(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """(path, length) of the files in folders, searched through, or named; nothing of them is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length"))


def dealt(plan: DataFrame, n: int, by: tuple[str, ...] = ("path", "at")) -> DataFrame:
    """Planned ranges in n tasks, those of a file side by side.  The number is named, for ranges are small rows that would else be put together."""
    return plan.repartitionByRange(max(1, min(n, MAX_TASKS)), *by)
