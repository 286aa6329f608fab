"""Files of a folder tree listed and read by tasks.

Spark's own readers leave out names that begin with ``.`` or ``_``, and one file that cannot be read ends their
job. Here every level of a tree is one job that lists its folders in parallel; contents are read from the
chosen paths, dealt evenly over tasks, and a file that cannot be read is a row with an error. Tasks reach the storage through Arrow's
file systems; ``reachable`` tells whether they know the scheme of a path.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Bytes that one task reads, about, and that one batch holds unless a single file is larger.
TASK_BYTES, BATCH_BYTES = 128 << 20, 16 << 20

Opener = Callable[[str], BinaryIO]


def is_local(path: str) -> str | None:
    """The path without its scheme if it is one of the local, or a mounted, file system; else None."""
    if path.startswith("file:"):
        return "/" + re.sub("^file:/*", "", path)
    return path if "://" not in path else None


def reachable(path: str) -> bool:
    """Whether tasks can list and read below this path."""
    if is_local(path) is not None:
        return True
    try:
        afs.FileSystem.from_uri(path)
    except Exception:  # an unknown scheme, or a missing client library or configuration
        return False
    return True


def open_path(path: str) -> BinaryIO:
    """A file opened for reading."""
    local = is_local(path)
    if local is not None:
        return open(local, "rb")
    system, inner = afs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _entries(folder: str) -> Iterator[tuple[str, int | None, bool]]:
    """(path, length, is a folder) of what lies directly in a folder; links to folders are not followed."""
    local = is_local(folder)
    if local is not None:
        with os.scandir(local) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, None, True
                elif entry.is_file():
                    yield entry.path, entry.stat().st_size, False
        return
    system, inner = afs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    for info in system.get_file_info(afs.FileSelector(inner)):
        yield prefix + info.path, info.size, info.type == afs.FileType.Directory


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            rows = list(_entries(folder))
            for at in range(0, len(rows), 10_000):
                path, length, is_folder = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(is_folder, pa.bool_())],
                    names=["path", "length", "is_folder"],
                )


def walk(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, length`` of every file below a folder, whatever its name; listed level by level when this is called.

    A folder that is not there raises; so does one that cannot be listed.
    """
    folders = spark.createDataFrame([(is_local(root) or root,)], "path string")
    files, cores = None, spark.sparkContext.defaultParallelism
    while True:
        path = scratch_dir(spark, "listed")
        listed = folders.mapInArrow(_list, "path string, length long, is_folder boolean")
        listed.write.parquet(path)
        level = spark.read.schema(listed.schema).parquet(path)
        here = level.where(~F.col("is_folder")).select("path", "length")
        files = here if files is None else files.union(here)
        below = level.where("is_folder").select("path")
        count = below.count() if recursive else 0
        if not count:
            return files
        folders = below.repartition(min(count, 8 * cores))


def read(files: DataFrame, limit: int, open_file: Opener = open_path) -> DataFrame:
    """``path, length, content, error`` of files ``path, length``; those above the limit are not opened and have neither.

    ``open_file(path)`` runs in the tasks; what it or reading raises as ``OSError`` is the row's error.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bytes | None, str | None]] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["path", "length", "content", "error"])

        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                content, error = None, None
                if length <= limit:
                    try:
                        with open_file(path) as file:
                            content = file.read()
                    except OSError as failure:
                        error = f"cannot be read: {failure.strerror or failure}"
                rows.append((path, length, content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    size = files.agg(F.sum(F.least("length", F.lit(limit))).alias("n")).first()["n"] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.repartition(int(tasks)).mapInArrow(contents, "path string, length long, content binary, error string")
